"""Secret scans with column expressions only: fixed patterns, and windows of high entropy.

Spans are [start, end) in code points. A candidate string is a run of 24 or more characters of one
class; a window slides over it while the sum of f(count) over its characters is kept by adding the
one that enters and taking off the one that leaves, f(c) = c log2 c in millionths. A low sum is a
high entropy: H = log2(window) - sum / window. Candidates on the allow-list are not reported, nor
windows inside a span of a fixed pattern. A find of the allow-list's placeholders or slashes excuses a
candidate only if the rest of it is plain: / is also a letter of base64, and a token may end a path.

Edge cases: null texts are empty and have no spans; repeated rows stay rows; columns of the output's
names are replaced; matches of any number cost time in proportion (blocks of ``_BLOCK`` spans).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm.rows import without

# fixed values: patterns of the base kinds, in the order of the report
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # runs are maximal, so the length may stand in the pattern
HEX = r"[0-9a-f]{16,}"
BASE_KINDS = ("assign", "access", "hex")

#: class, pattern of a candidate, window, least entropy in bits
CLASSES = (
    ("entropy_hex", r"[0-9A-Fa-f]{32,}", 32, 3.0),
    ("entropy_b64", r"[A-Za-z0-9+/_-]{24,}", 24, 4.0),
)
KINDS = (*BASE_KINDS, *(c[0] for c in CLASSES))
ALLOWED = (
    r"^[A-Za-z]+$",  # words
    r"^[0-9]+$",  # plain numbers
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # identifiers made to be public
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]?(key|token|secret)|xxxx|0123456789|abcdefgh",
    r"^/|/.*/.*/",  # paths
)
_PLACEHOLDER, _PATH = ALLOWED[3:]
_WHOLE = ALLOWED[:3]  # these match all of a candidate
#: Words, capitals, numbers and single signs of a name; random letters have one for every two characters.
_PIECES = r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
_SCALE = 1_000_000
_BLOCK = 256
_SPANS = "array<struct<start:bigint,end:bigint,kind:int>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans_of(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost non-overlapping matches as spans with the matched text: array<struct<start,end,kind,found>>.

    The lengths of the pieces between the matches and of the matches add up to the positions. Spans
    are collected in blocks, so that appending does not copy all of them each time.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    row = "struct<start:bigint,end:bigint,kind:int,found:string>"

    def place(found: Column) -> Column:
        pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda gap, hit: F.struct(
            F.length(gap).cast("long").alias("gap"), F.length(hit).cast("long").alias("size"), hit.alias("found")))
        return _let(pairs, in_blocks)

    def in_blocks(pairs: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast(f"array<array<{row}>>").alias("out"))

        def one_block(acc: Column, b: Column) -> Column:
            inner = F.aggregate(
                F.slice(pairs, b * _BLOCK + 1, F.lit(_BLOCK)),
                F.struct(acc["pos"].alias("pos"), F.array().cast(f"array<{row}>").alias("out")), one)
            return _let(inner, lambda r: F.struct(r["pos"].alias("pos"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

        def one(acc: Column, p: Column) -> Column:
            begin = acc["pos"] + p["gap"]
            span = F.struct(begin.alias("start"), (begin + p["size"]).alias("end"), F.lit(kind).alias("kind"), p["found"].alias("found"))
            return F.struct((begin + p["size"]).alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

        blocks = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _BLOCK).cast("int"))
        return F.flatten(F.aggregate(blocks, start, one_block, lambda acc: acc["out"]))

    return _let(hits, lambda h: F.when(F.size(h) > 0, place(h)).otherwise(F.array().cast(f"array<{row}>")))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])).cast(_SPANS)


def _table(window: int) -> list[int]:
    return [round(_SCALE * c * math.log2(c)) if c else 0 for c in range(window + 1)]


def entropy_limit(window: int, least: float) -> int:
    """Greatest sum of f(count) that still has ``least`` bits."""
    return math.floor(_SCALE * window * (math.log2(window) - least))


# counts of a window's characters: a text with one character per place from _FIRST on, its code 32 plus the count
_FIRST, _PLACES = ord("+"), ord("z") - ord("+") + 1


def dense_part(candidate: Column, window: int, least: float) -> Column:
    """(lo, hi): from the first to the last window of enough entropy, inside the candidate; null if none.

    A step takes the leaving character off its count and adds the entering one to its own; the sum
    changes by the two differences of f. No window is counted anew.
    """
    f = F.array(*[F.lit(v).cast("long") for v in _table(window)])
    limit = F.lit(entropy_limit(window, least)).cast("long")

    def moved(held: Column, total: Column, place: Column, by: int) -> Column:
        """The counts and their sum after one character came (1) or went (-1)."""
        return _let(F.ascii(F.substr(held, place, F.lit(1))) - 32, lambda n: F.struct(
            F.overlay(held, F.char(n + (32 + by)), place, F.lit(1)).alias("held"),
            (total + F.element_at(f, n + 1 + by) - F.element_at(f, n + 1)).alias("sum")))

    def over(places: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:  # i: place of the entering character, from 1
            kept = F.when(i > window, moved(acc["held"], acc["sum"], F.element_at(places, F.greatest(i - window, F.lit(1))), -1)).otherwise(
                F.struct(acc["held"].alias("held"), acc["sum"].alias("sum")))
            full = _let(kept, lambda k: moved(k["held"], k["sum"], F.element_at(places, i), 1))
            return _let(full, lambda s: F.struct(
                s["held"].alias("held"), s["sum"].alias("sum"),
                F.when((i >= window) & (s["sum"] <= limit), F.coalesce(acc["lo"], (i - window).cast("long"))).otherwise(acc["lo"]).alias("lo"),
                F.when((i >= window) & (s["sum"] <= limit), i.cast("long")).otherwise(acc["hi"]).alias("hi"),
            ))

        none = F.lit(None).cast("long")
        start = F.struct(F.lit(" " * _PLACES).alias("held"), F.lit(0).cast("long").alias("sum"), none.alias("lo"), none.alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.size(places)), start, step, lambda acc: F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi")))

    return _let(F.transform(F.split(candidate, ""), lambda c: F.ascii(c) - (_FIRST - 1)), over)


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base_spans and entropy_spans: arrays of (start, end, kind), kind by ``KINDS``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = without(docs, "base_spans", "entropy_spans").withColumns({
        "__assign": F.filter(spans_of(whole, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= ASSIGN_LENGTH),
        "__access": F.when(whole.contains("AKIA"), spans_of(whole, ACCESS, 1)),
        "__hex": spans_of(whole, HEX, 2),
        **{f"__{name}": _not_allowed(spans_of(whole, pattern, 3 + k), window) for k, (name, pattern, window, _) in enumerate(CLASSES)},
    })
    none = F.array().cast(_SPANS)
    base = F.concat(_plain(F.col("__assign")), F.coalesce(_plain(F.col("__access")), none), _plain(F.col("__hex")))
    found = found.withColumn("base_spans", F.array_sort(base, _by_start)).withColumn("__dense", F.concat(*[
        _dense_spans(F.col(f"__{name}"), window, least) for name, _, window, least in CLASSES]))
    outside = F.filter("__dense", lambda d: ~F.exists("base_spans", lambda b: (b["start"] <= d["start"]) & (d["end"] <= b["end"])))
    found = found.withColumn("entropy_spans", F.array_sort(outside, _by_start))
    return found.drop("__assign", "__access", "__hex", "__dense", *[f"__{c[0]}" for c in CLASSES])


def _dense_spans(candidates: Column, window: int, least: float) -> Column:
    inside = F.transform(candidates, lambda s: _let(dense_part(s["found"], window, least), lambda d: F.struct(
        (s["start"] + d["lo"]).alias("start"), (s["start"] + d["hi"]).alias("end"), s["kind"].alias("kind"))))
    return F.filter(inside, lambda s: s["start"].isNotNull()).cast(_SPANS)


def _by_start(a: Column, b: Column) -> Column:
    order = F.lit(0)
    for name in ("end", "kind", "start"):
        order = F.when(a[name] < b[name], -1).when(a[name] > b[name], 1).otherwise(order)
    return order


def _plain_name(name: Column) -> Column:
    """Few pieces for its length, or on the allow-list as a whole: a name, not a random string."""
    plain = (F.size(F.regexp_extract_all(name, F.lit(_PIECES), F.lit(0))) - 1) * 4 <= F.greatest(F.lit(4), F.length(name))
    for pattern in _WHOLE:
        plain = plain | name.rlike(pattern)
    return plain


def _allowed(candidate: Column, window: int) -> Column:
    """On the allow-list. A path is one only if all its segments are plain names, and a placeholder
    excuses a candidate only if what is left without it is plain too, or too short for a window."""
    allowed = F.lit(False)
    for pattern in _WHOLE:
        allowed = allowed | candidate.rlike(pattern)
    rest = F.regexp_replace(candidate, _PLACEHOLDER, "")
    path = candidate.rlike(_PATH) & F.forall(F.split(rest, "/"), _plain_name)
    return allowed | path | (candidate.rlike(_PLACEHOLDER) & ((F.length(rest) < window) | F.forall(F.split(rest, "/"), _plain_name)))


def _not_allowed(spans: Column, window: int) -> Column:
    return F.filter(spans, lambda s: ~_allowed(s["found"], window))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans."""
    found = with_spans(docs.select("doc_id", "text")).drop("text")

    def of(kind: int) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.size("entropy_spans").cast("long").alias("n_entropy"), F.sha2(_listed(F.col("base_spans")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base_spans", "entropy_spans"), _by_start)).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mark``; n_chars follows, all other columns stay."""
    columns = docs.columns
    i = columns.index("text")
    found = with_spans(docs.withColumnsRenamed({c: f"c{k}" for k, c in enumerate(columns)}), f"c{i}")
    found = found.withColumn("__spans", F.array_sort(F.concat("base_spans", "entropy_spans"), _by_start))
    text = F.col(f"c{i}")

    def add(acc: Column, s: Column) -> Column:  # pos: end of what is done
        begin, end = F.greatest(s["start"], acc["pos"]), F.greatest(s["end"], acc["pos"])
        gap = F.substring(text, (acc["pos"] + 1).cast("int"), (begin - acc["pos"]).cast("int"))
        fresh = (s["start"] >= acc["pos"]) | (acc["pos"] == 0)
        piece = F.when(fresh, F.concat(gap, F.lit(mark))).otherwise(F.lit(""))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(piece)).alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["pos"] + 1).cast("int"), F.length(text)))

    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("out"))
    clean = F.when(F.size("__spans") > 0, F.aggregate("__spans", start, add, finish)).otherwise(text)
    found = found.withColumn("__clean", clean)
    made = []
    for k, c in enumerate(columns):
        value = F.col("__clean") if k == i else F.col(f"c{k}")
        if c == "n_chars":
            value = F.when(F.size("__spans") > 0, F.length("__clean").cast(docs.schema[c].dataType)).otherwise(F.col(f"c{k}"))
        made.append(value.alias(c))
    return found.select(*made)
