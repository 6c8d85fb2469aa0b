"""Chains of predicates and auxiliaries written without spaces, as paths over the segments of a text.

Segments are distinct texts, analysed once however many texts hold them. An edge is a predicate reading of
a segment at a place of a text. The edges of a text are a packed forest: each edge knows the edges that it may follow
and how many chains end in it, so that no dead end is walked, and chains are written out one by one without any cutoff.

Edges are sorted by text within their partition and read as a stream: a task holds the edges of one text and a bounded
batch of chains, however many texts it has."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hangul as H
from ..rules import auxiliaries as A
from ..rules import endings as E
from ..rules.followers import before_particle, before_particle_column
from .predicates import LEMMA, MORPH

#: Characters of a later predicate before its markers (안 and the longest stem) and after them (the longest ending, with a particle).
HEAD_CHARS = 1 + max(map(len, [*A.auxiliary_stems(), "되", "말"]))
ENDING_CHARS = 1 + max(len(r[0]) for r in E.ending_rows())
#: Morphemes of the chains that are written out together.
BATCH_MORPHEMES = 200_000
#: Particles that a connective may carry before the next predicate.
INNER = ("들", "도", "만", "는", "야", "나", "가", "를", "로")
_ALLOWED = set(A.link_rows())
_STEMS = set(A.auxiliary_stems())
READING = f"text string, stem string, form string, connector boolean, copula_only boolean, ha boolean, dap boolean, morphemes array<{MORPH}>, following array<{LEMMA}>, rules array<string>, spellings array<string>"
COLUMNS = [c.split()[0] for c in READING.split(", ")]


def marker_class() -> str:
    """A regular expression for the syllables that can stand between the stem and the ending of one predicate: those of markers, with
    whatever final consonant the next marker or the ending gives them; those in 었 as it is written on a vowel; and shortened negations with their clauses."""
    own = {H.split_char(c)[:2] for row in E.MARKERS for c in row[1]} | {H.split_char(c)[:2] for c in "지하"}
    blocks = [chr(0xAC00 + (i * 21 + v) * 28) + "-" + chr(0xAC00 + (i * 21 + v) * 28 + 27) for i, v in sorted(own)]
    past = [chr(0xAC00 + k * 28 + 20) for k in range(19 * 21)]
    return f"[{''.join(blocks)}{''.join(past)}잖찮]"


def segments(texts: DataFrame, text: str = "text") -> DataFrame:
    """text, start, stop, n and segment for each part that a chain could use.

    A part after the first starts with the initial of an auxiliary, of 말다 or of 되다, and between its head and its ending it has nothing but
    syllables of markers, so that it may be of any length; a first part may be any prefix before such a place."""
    initials = sorted({H.split_char(s[0])[0] for s in [*A.auxiliary_stems(), "되", "말", "안"]})
    w, n = F.col(text), F.char_length(text)
    ok = texts.where(H.has_hangul(w) & (n > 1))
    starts = F.filter(F.sequence(F.lit(1), n - 1), lambda i: H.initial(H.index(F.substring(w, i + 1, F.lit(1)))).isin(*initials))
    df = ok.select(w.alias("text"), n.alias("n"), starts.alias("starts")).where(F.size("starts") > 0)
    df = df.select("text", "n", "starts", F.explode(F.array_append("starts", F.lit(0))).alias("start"))
    marked = F.char_length(F.regexp_extract(F.substring("text", F.col("start") + 1 + HEAD_CHARS, F.col("n")), f"^{marker_class()}*", 0))
    df = df.withColumn("reach", F.col("start") + HEAD_CHARS + ENDING_CHARS + F.when(F.col("start") > 0, marked).otherwise(0))
    ends = F.filter(F.array_append("starts", F.col("n")), lambda j: (j > F.col("start")) & ((F.col("start") == 0) | (j <= F.col("reach"))) & ((F.col("start") > 0) | (j < F.col("n"))))
    df = df.select("text", "n", "start", F.explode(ends).alias("stop"))
    return df.select("text", "n", "start", "stop", F.substring("text", F.col("start") + 1, F.col("stop") - F.col("start")).alias("segment"))


def inner_variants(parts: DataFrame) -> DataFrame:
    """segment, base, particle and rule of each way to read a segment as a connective clause with a particle; and 안 taken off."""
    s, n = F.col("segment"), F.char_length("segment")
    i = H.index(H.last_char(s))
    cut = lambda k: F.left(s, n - k)
    none = F.array().cast("array<string>")
    way = lambda when, base, particle, need, rules, bridge=False: F.when(when & (n > 1), F.struct(base.alias("base"), F.lit(particle).alias("particle"), F.lit(need).alias("need"), (F.array(*map(F.lit, rules)) if rules else none).alias("why"), F.lit(bridge).alias("bridge")))
    ways = [way(s.endswith(p), cut(1), p, None, ("particle",)) for p in INNER]
    ways += [way(s.endswith(short), F.concat(cut(1), F.lit(full)), "는", full, ("particle", "particle.contraction.n")) for short, full in (("곤", "고"), ("진", "지"))]
    ways.append(way(H.coda(i) == 8, H.replace_last(s, H.vowel(i), F.lit(0)), "를", None, ("particle", "particle.contraction.l")))
    return parts.select("segment").distinct().select("segment", F.inline(F.filter(F.array(*ways), lambda x: x.isNotNull())))


def with_particles(variants: DataFrame, readings: DataFrame) -> DataFrame:
    """Readings of segments that end in an internal particle."""
    df = variants.join(readings, variants["base"] == readings["text"]).where("connector")
    ending = F.col("form")
    contracted = F.col("need").isNotNull()
    ok = F.when(contracted, ending == F.col("need")).when(F.array_contains("why", "particle.contraction.l"), before_particle_column(ending, F.lit("를")))
    ok = ok.when(F.col("particle") == "로", ending == "기").otherwise((ending == "기") | before_particle_column(ending, F.col("particle")))
    morphs = F.concat("morphemes", F.array(F.struct(F.col("particle").alias("form"), F.lit("Particle").alias("kind"))))
    return df.where(ok).select(F.col("segment").alias("text"), *[morphs.alias("morphemes") if c == "morphemes" else F.array_distinct(F.concat("rules", "why")).alias("rules") if c == "rules" else F.col(c) for c in COLUMNS[1:]])


@dataclass(slots=True)
class Piece:
    """A predicate reading at a place of a text; leading: the adverb 안 before it."""

    stem: str
    connector: bool
    copula_only: bool
    ha: bool
    dap: bool
    morphs: list[tuple[str, str]]
    following: list[tuple[str, str]]
    rules: frozenset[str]
    spellings: list[str]
    leading: bool = False

    def ending(self) -> int:
        """The place of the last ending."""
        return max(k for k, (_, kind) in enumerate(self.morphs) if kind == "Ending")

    def own_markers(self) -> list[str]:
        """The markers of the predicate that the last ending belongs to."""
        end, out = self.ending(), []
        for form, kind in reversed(self.morphs[:end]):
            if kind == "Ending":
                break
            if kind == "Prefinal":
                out.append(form)
        return out


def _paired(form: str, with_: str) -> bool:
    form = form.removesuffix("요")
    if with_ in ("을까", "든지", "든", "거나", "거니", "건"):
        return form == with_
    return form == "지" if with_ == "을지" else with_ in ("나", "으나") and form in ("나", "으나")


def _mal(left: Piece, right: Piece, branch: str | None) -> bool:
    """Whether right is lexical 말다 behind left: a break off, or the second of two alternatives."""
    if right.stem != "말" or right.leading or "irregular.mal" in right.rules or left.morphs[-1][1] != "Ending":
        return False
    last = left.morphs[-1][0]
    if last in ("다", "다가", "으려다", "으려다가"):
        return True
    if last == "어":
        return left.stem == "슬프" and not left.following
    form, kind = right.morphs[-1]
    pair = kind == "Ending" and _paired(form, last)
    own = pair and all(k == "Prefinal" for _, k in right.morphs[:-1]) and (form.removesuffix("요") != "으나" or (len(right.morphs) > 1 and right.morphs[-2][0] in E.TENSE))
    return own or (right.connector and not pair and branch is not None and _paired(branch, last))


def _doeda(left: Piece, right: Piece) -> tuple[str, str] | None:
    if right.stem != "되":
        return None
    at = left.ending()
    form, particles = left.morphs[at][0], [p for p, _ in left.morphs[at + 1 :]]
    if (form == "도록" and not particles) or (form == "기" and particles == ["로"]):
        return "Predicate", "lexical.doeda.extended"
    if (form in ("어야", "으면", "어도") and not particles) or (form == "어" and particles in (["야"], ["도"])) or (right.leading and ((form == "어서" and particles == ["는"]) or (form == "어서는" and not particles))):
        return "Auxiliary", "auxiliary.doeda.extended"
    return None


def _finite(right: Piece) -> bool:
    ends = [k for k, (_, kind) in enumerate(right.morphs) if kind == "Ending"]
    form = right.morphs[ends[0]][0]
    return right.stem in ("하", "들") and (form in ("는다", "다", "어요", "습니다") or (form == "어" and right.morphs[ends[0] + 1 : ends[0] + 2] == [("요", "Particle")]))


def _particle_joins(form: str, particle: str, stem: str) -> bool:
    listed = (form, stem) in _ALLOWED
    if particle in ("도", "만", "들"):
        return (form == "기" and stem == "하" and particle != "들") or (listed and before_particle(form, particle))
    if particle == "는":
        return (stem == "하" and form in ("고", "기")) or (stem == "싶" and form == "고") or (stem in ("있", "계시") and form in ("고", "어")) or (form == "지" and listed)
    if particle == "나":
        return stem == "하" and form == "기"
    if particle in ("가", "를"):
        return listed and before_particle(form, particle)
    return particle == "야" and ((stem == "하" and form == "기") or (stem == "말" and form == "고"))


def _auxiliary(left: Piece, right: Piece) -> bool:
    at = left.ending()
    form, particles = left.morphs[at][0], [p for p, _ in left.morphs[at + 1 :]]
    if len(particles) > 1 or not (_particle_joins(form, particles[0], right.stem) if particles else (form, right.stem) in _ALLOWED):
        return False
    markers = left.own_markers()
    if form == "으려고" and _finite(right) and any(m not in E.HONORIFIC for m in markers):
        return False
    if form == "고" and right.stem in ("있", "계시") and "어야겠" in markers:
        return False
    if "irregular.mal" in right.rules and form != "지":
        return False
    if form == "으면" and ("었", "Prefinal") not in left.morphs[:at]:
        return False
    forms = [f for f, _ in right.morphs]
    if right.stem in ("가지", "갖"):
        return forms == ["고"]
    if right.stem == "달":
        return len(forms) == 1 and forms[0] in A.REQUESTS.split()
    if right.stem == "보" and form in ("다", "다가", "으려다", "으려다가"):
        return forms in (["으니"], ["으면"])
    return True


def link(left: Piece, right: Piece, branch: str | None) -> tuple[str, list[str]] | None:
    """The role of right behind left and the rules that say so."""
    if _mal(left, right, branch):
        return "Predicate", ["lexical.mal.complement"] + ([] if _mal(left, right, None) else ["lexical.mal.paired_branch"])
    if found := _doeda(left, right):
        return found[0], [found[1]]
    return ("Auxiliary", ["auxiliary"]) if not right.leading and _auxiliary(left, right) else None


Link = tuple[str, list[str]]


class Forest:
    """The packed chains over a text of n characters. edges: (start, stop, piece); those at 0 are bases.

    A node is an edge under the last form of its chain, which decides on the branches of 말다; left has, for each node,
    the nodes that it may follow with the link, and count the chains that end in it."""

    def __init__(self, n: int, edges: list[tuple[int, int, Piece]]) -> None:
        self.edges = edges
        by_stop: dict[int, list[int]] = defaultdict(list)
        for k, (_, stop, piece) in enumerate(edges):
            if piece.connector:
                by_stop[stop].append(k)
        last = lambda piece: piece.morphs[-1]
        self.roots = [(k, last(p)[0]) for k, (start, stop, p) in enumerate(edges) if stop == n and start and last(p)[1] == "Ending"]
        self.left: dict[tuple[int, str], list[tuple[tuple[int, str], Link]]] = {}
        todo = list(self.roots)
        while todo:
            node = todo.pop()
            if node in self.left:
                continue
            k, branch = node
            start, _, piece = edges[k]
            found = self.left[node] = [((j, branch), how) for j in by_stop[start] if (how := link(edges[j][2], piece, branch))] if start else []
            todo += [other for other, _ in found if other not in self.left]
        self.count: dict[tuple[int, str], int] = {}
        for node in sorted(self.left, key=lambda x: edges[x[0]][0]):  # what a node follows starts before it
            self.count[node] = sum(self.count[other] for other, _ in self.left[node]) if edges[node[0]][0] else 1
        for node, found in self.left.items():
            self.left[node] = [x for x in found if self.count[x[0]]]

    def size(self) -> int:
        """The number of chains of two pieces or more."""
        return sum(self.count[r] for r in self.roots)

    def chains(self) -> Iterator[tuple[list[Piece], list[Link]]]:
        """Each chain, its pieces and the links between them."""
        todo: list[tuple] = [(root, None) for root in self.roots if self.count[root]]
        while todo:
            node, rest = todo.pop()
            if not self.edges[node[0]][0]:
                pieces, links = [self.edges[node[0]][2]], []
                while rest is not None:
                    right, how, rest = rest
                    pieces.append(self.edges[right][2])
                    links.append(how)
                yield pieces, links
            else:
                todo += [(other, (node[0], how, rest)) for other, how in self.left[node]]


def joined(pieces: list[Piece], links: list[Link]) -> tuple:
    """A chain as one reading: stem, form, connector, copula_only, ha, dap, morphemes, following, rules, spellings."""
    base, last = pieces[0], pieces[-1].morphs[-1][0]
    morphs, following, rules, spellings = list(base.morphs), list(base.following), set(base.rules), list(base.spellings)
    for left, right, (role, why) in zip(pieces, pieces[1:], links, strict=False):
        rules |= right.rules | set(why) | ({"auxiliary"} if role == "Auxiliary" else set()) | ({"auxiliary.internal_particle"} if left.morphs[-1][1] == "Particle" else set())
        following += [*([("안", "Adverbial")] if right.leading else []), (right.stem + "다", role), *right.following]
        morphs += right.morphs
        spellings += right.spellings
    pair = lambda xs, a: [{a: x, "kind": k} for x, k in xs]
    return base.stem, last, pieces[-1].connector, base.copula_only, base.ha, base.dap, pair(morphs, "form"), pair(following, "text"), sorted(rules), spellings


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, tuple[int, int, Piece]]]:
    """The edges in their order, each distinct reading as one object for a batch."""
    for b in batches:
        made: dict[str, Piece] = {}
        columns = {c: b.column(c) for c in b.schema.names}
        places = [columns[c].to_pylist() for c in ("text", "n", "start", "stop", "reading")]
        body = [c for c in columns if c not in ("text", "n", "start", "stop", "reading")]
        for k, (text, n, start, stop, reading) in enumerate(zip(*places, strict=True)):
            if (piece := made.get(reading)) is None:
                r = {c: columns[c][k].as_py() for c in body}
                piece = made[reading] = Piece(r["stem"], r["connector"], r["copula_only"], r["ha"], r["dap"], [(m["form"], m["kind"]) for m in r["morphemes"]], [(x["text"], x["kind"]) for x in r["following"]], frozenset(r["rules"]), r["spellings"], r["leading"])
            yield text, n, (start, stop, piece)


def _write_out(schema: pa.Schema):  # noqa: ANN202
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for (text, n), own in groupby(_edges(batches), lambda x: x[:2]):
            for pieces, links in Forest(n, [e for _, _, e in own]).chains():
                rows.append((text, *joined(pieces, links)))
                size += len(rows[-1][7])
                if size >= BATCH_MORPHEMES or len(rows) >= 10_000:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    return run


def chains(parts: DataFrame, readings: DataFrame) -> DataFrame:
    """Readings (see READING) of the texts of parts as chains of two predicates or more. readings: those of all segments, internal particles included."""
    from pyspark.sql.pandas.types import to_arrow_schema

    end = F.col("stop") == F.col("n")
    closed = F.try_element_at("morphemes", F.lit(-1))["kind"] == "Ending"
    body = [F.col(c) for c in COLUMNS[1:]]
    r = readings.withColumnRenamed("text", "segment")
    plain = parts.join(r, "segment").select("text", "n", "start", "stop", *body, F.lit(False).alias("leading"))
    # 안 before 되다 belongs to the segment that starts with it.
    an = parts.where(F.col("segment").startswith("안") & (F.col("start") > 0)).withColumn("segment", F.expr("substring(segment, 2)"))
    bridge = an.join(r.where("stem = '되'"), "segment").select("text", "n", "start", "stop", *[F.array_append("rules", F.lit("doeda.negative_bridge")).alias("rules") if c == "rules" else F.col(c) for c in COLUMNS[1:]], F.lit(True).alias("leading"))
    edge = plain.unionByName(bridge)
    tail = (F.col("start") > 0) & (F.col("leading") | F.col("stem").isin("되", "말", *_STEMS)) & F.when(end, closed).otherwise(F.col("connector"))
    edge = edge.where(((F.col("start") == 0) & F.col("connector")) | tail)
    # Texts without a last edge have no chain.
    open_ = edge.where(end).select("text").distinct()
    schema = parts.sparkSession.createDataFrame([], READING).schema
    told = edge.withColumn("reading", F.concat_ws(":", F.xxhash64(*body, "leading"), F.hash(*body, "leading"))).join(open_, "text", "left_semi")
    # Dealt by an expression of its own: a shuffle by the text itself counts as done where a join has dealt by it, and may then be read locally.
    return told.repartition(F.xxhash64("text", F.lit(1))).sortWithinPartitions("text").mapInArrow(_write_out(to_arrow_schema(schema)), schema)
