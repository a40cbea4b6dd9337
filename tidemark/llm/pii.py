"""Personal data: patterns, and terms that reveal them.

Patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers.
The information-theoretic step then asks which *other* words give such an entity
away: over the N distinct texts of the corpus it counts in how many a term
occurs, in how many an entity occurs, and in how many the term stands near it.
A term discloses an entity when its pointwise mutual
information with it reaches ``alpha`` times the entity's own information,

    log(n(t, e) * N / (n(t) * n(e)))  >=  alpha * log(N / n(e)),

the two having met in at least ``support`` texts.  Disclosing terms are
removed, or generalised to a placeholder, where they stand near the entity.

All of it is DataFrame operations; places are code points, ends exclusive.

Edge cases: null and empty texts have no spans; rows that share a doc_id and a
text get the same spans; exact copies of a text count once, in all four numbers;
extra columns pass through in ``sanitize``, whatever their names.  A very long
text is one row, its matches are placed in blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, small, spill, words

_LEFT = "[A-Za-z0-9._%+-]"
#: Patterns by kind, in the order that breaks ties.  A leading look-behind (or the end of the match before) lets a
#: run of characters be tried from its start only; any later start in the run fails or succeeds with it.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LEFT})){_LEFT}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: What a text without a match of the kind lacks.
_NEEDS = {"email": "@", "phone": "+"}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    d = F.split(F.reverse(digits), "")
    doubled = F.transform(
        F.filter(d, lambda x: x != ""),
        lambda x, i: let(
            x.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        def part(x: Column) -> Column:
            return let(F.regexp_replace(x, "^0+", ""), lambda y: (F.length(y) < 3) | ((F.length(y) == 3) & (y <= "255")))

        return F.forall(F.split(m, "\\."), part)
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False)))
    return F.length(_digits(m)).between(9, 15)


def _running(xs: Column, fold, zero: Column) -> Column:
    """For each item the fold of all before it.

    An array that grows by one is copied each time; beyond a few items it is
    therefore done for blocks of sqrt(n) and within them.
    """

    def plain(items: Column) -> Column:
        begin = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda a, x: F.struct(fold(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(items, begin, step)["out"]

    def blocked(items: Column, b: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.ceil(F.size(items) / b).cast("int") - 1)
        heads = plain(F.transform(blocks, lambda j: F.aggregate(F.slice(items, j * b + 1, b), zero, fold)))

        def inside(j: Column, head: Column) -> Column:
            places = F.sequence(F.lit(0), F.least(b, F.size(items) - j * b) - 1)
            return F.transform(places, lambda i: F.aggregate(F.slice(items, j * b + 1, i), head, fold))

        return let(heads, lambda h: F.flatten(F.transform(blocks, lambda j: inside(j, F.get(h, j)))))

    root = F.ceil(F.sqrt(F.size(xs))).cast("int")
    return F.when(F.size(xs) <= 64, plain(xs)).otherwise(blocked(xs, root))


def _matches(text: Column, kind: str) -> Column:
    """All valid matches: array of (start, k, stop, value), ``k`` being the kind's place in KINDS."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))

    def placed(pair: Column) -> Column:
        m, gaps = pair["m"], pair["g"]
        # a match starts after its gap, and after all gaps and matches before that
        steps = F.transform(m, lambda x, i: F.get(gaps, i) + F.length(x))
        before = let(steps, lambda x: _running(x, lambda a, y: a + y, F.lit(0)))
        sums = F.zip_with(before, F.slice(gaps, 1, F.size(m)), lambda at, gap: at + gap)
        rows = F.transform(
            F.arrays_zip(m.alias("m"), sums.alias("s")),
            lambda x: F.struct(
                x["s"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), (x["s"] + F.length(x["m"])).alias("stop"), x["m"].alias("value")
            ),
        )
        return F.filter(rows, lambda x: _valid(kind, x["value"]))

    none = F.array().cast("array<struct<start:int,k:int,stop:int,value:string>>")
    # in the few texts with a match, the text is cut at its matches once more to place them
    some = let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(let(F.struct(m.alias("m"), between.alias("g")), placed)))
    need = _NEEDS.get(kind)
    return F.when(F.contains(text, F.lit(need)), some).otherwise(none) if need else some


def base_spans(text: Column) -> Column:
    """Array of (start, k, stop, value) of the patterns, by start and then by kind."""
    return F.sort_array(F.concat(*[_matches(F.coalesce(text, F.lit("")), k) for k in KINDS]))


def _token(w: Column) -> Column:
    """A word as a term: lower case, without punctuation around it."""
    return F.regexp_replace(F.lower(w), "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", "")


def _around(text: Column, spans: Column, width: int) -> Column:
    """For each span the words, ``width`` on either side: array of (value, k, terms: array of (t, start, stop)).

    What touches the span is the rest of a word that it cut, and is left out.
    """
    gap, word = "[\\x20\\x09-\\x0D]", "[^\\x20\\x09-\\x0D]"
    # from the span outwards: the rest of a cut word, then whole words; before the span the text is read backwards
    reach = f"^({word}*+(?:{gap}++{word}++){{0,{width}}})"

    def placed(piece: Column, start: Column) -> Column:
        gaps = F.split(piece, f"{word}+", -1)
        found = F.regexp_extract_all(piece, F.lit(f"{word}+"), F.lit(0))
        rows = F.aggregate(
            F.sequence(F.lit(1), F.size(found)),
            F.struct(start.alias("at"), F.array().cast("array<struct<t:string,start:int,stop:int>>").alias("w")),
            lambda a, i: let(
                F.struct((a["at"] + F.length(F.get(gaps, i - 1))).alias("from"), F.get(found, i - 1).alias("t")),
                lambda x: F.struct(
                    (x["from"] + F.length(x["t"])).alias("at"),
                    F.concat(
                        a["w"],
                        F.array(F.struct(x["t"].alias("t"), x["from"].alias("start"), (x["from"] + F.length(x["t"])).alias("stop"))),
                    ).alias("w"),
                ),
            ),
        )["w"]
        return F.when(F.size(found) > 0, rows).otherwise(F.array().cast("array<struct<t:string,start:int,stop:int>>"))

    def one(s: Column) -> Column:
        # what reaches the edge of the near text is looked for in the whole
        def found(near: Column, whole: Column) -> Column:
            return let(F.regexp_extract(near, reach, 1), lambda x: F.when(F.length(x) < near_by, x).otherwise(F.regexp_extract(whole, reach, 1)))

        near_by = 24 * width
        first = F.greatest(s["start"] - near_by, F.lit(0))
        back = found(F.reverse(F.substring(text, first + 1, s["start"] - first)), F.reverse(F.substring(text, F.lit(1), s["start"])))
        ahead = found(F.substring(text, s["stop"] + 1, F.lit(near_by)), F.substring(text, s["stop"] + 1, F.length(text)))
        before = let(F.reverse(back), lambda x: placed(x, s["start"] - F.length(x)))
        after = let(ahead, lambda x: placed(x, s["stop"]))
        whole = F.concat(F.filter(before, lambda w: w["stop"] < s["start"]), F.filter(after, lambda w: w["start"] > s["stop"]))
        return F.struct(s["value"].alias("value"), s["k"].alias("k"), whole.alias("terms"))

    return F.transform(spans, one)


def find_spans(docs: DataFrame, alpha: float = 0.8, support: int = 3, width: int = 5) -> DataFrame:
    """(doc_id, th, base, terms) for each row: spans of the patterns and of disclosing terms; ``th`` is xxhash64 of the text.

    ``base`` is an array of (start, k, stop, value), ``terms`` one of (start, stop, term).
    """
    rows = docs.select("doc_id", "text").withColumn("base", base_spans(F.col("text")))
    rows = rows.withColumn("around", F.when(F.size("base") > 0, _around(F.coalesce("text", F.lit("")), F.col("base"), width)))
    spanned = spill(rows.select("doc_id", "base", "around", F.xxhash64("text").alias("th")), "spans")

    near = spanned.where("around is not null").select("doc_id", "th", F.explode("around").alias("c"))
    near = near.select(
        "doc_id", "th", F.concat_ws(":", "c.k", F.lower("c.value")).alias("e"), F.col("c.terms").alias("raw"),
        F.transform("c.terms", lambda w: F.struct(_token(w["t"]).alias("t"), w["start"].alias("start"), w["stop"].alias("stop"))).alias("terms"),
    )
    # everything is counted in distinct texts, so that copies weigh on no side
    entity = near.select("e", "th").distinct().groupBy("e").agg(F.count("*").alias("ne")).where(F.col("ne") >= support)
    entity = spill(entity, "entities")
    joint = near.join(small(entity), "e").select("e", "ne", "th", F.explode(F.array_distinct(F.transform("terms", lambda w: w["t"]))).alias("t"))
    joint = joint.where("t rlike '\\\\p{L}'").distinct()
    joint = spill(joint.groupBy("e", "ne", "t").agg(F.count("*").alias("nj")).where(F.col("nj") >= support), "joint")
    total = docs.where("text is not null").select(F.xxhash64("text")).distinct().count()
    none = F.array().cast("array<struct<start:int,stop:int,term:string>>")
    if joint.isEmpty():
        return spanned.select("doc_id", "th", "base", none.alias("terms"))

    def telling(texts: str) -> Column:
        pmi = F.log(F.col("nj") * F.lit(float(total)) / (F.col(texts) * F.col("ne")))
        return pmi >= alpha * F.log(F.lit(float(total)) / F.col("ne"))

    # a term occurs in at least the texts where it stands beside any entity, which rules most common words out
    beside = near.select("th", F.explode(F.array_distinct(F.transform("terms", lambda w: w["t"]))).alias("t"))
    beside = beside.join(small(spill(joint.select("t").distinct(), "near-terms")), "t", "left_semi")
    least = beside.distinct().groupBy("t").agg(F.count("*").alias("least"))
    joint = spill(joint.join(least, "t").where(telling("least")).drop("least"), "open")
    # in how many texts the terms occur that may still disclose anything, over all documents
    asked = spill(joint.select("t").distinct(), "asked")
    texts = docs.where("text is not null").select(F.xxhash64("text").alias("th"), words(F.col("text"), SPACE).alias("w"))
    terms = texts.select("th", F.explode(F.array_distinct(F.transform("w", _token))).alias("t"))
    df = terms.join(small(asked), "t").distinct().groupBy("t").agg(F.count("*").alias("nt"))
    told = joint.join(df, "t").where(telling("nt")).select("e", "t")
    told = spill(told, "disclosing")
    keys = small(told.toDF("e2", "t2"))
    hits = near.select("doc_id", "th", "e", F.explode("terms").alias("w"))
    hits = hits.join(keys, (F.col("e") == F.col("e2")) & (F.col("w.t") == F.col("t2")), "left_semi")
    hits = hits.groupBy("doc_id", "th").agg(
        F.sort_array(F.collect_set(F.struct(F.col("w.start").alias("start"), F.col("w.stop").alias("stop"), F.col("w.t").alias("term")))).alias("terms")
    )
    hits = spill(hits.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "terms"), "terms")
    key = spanned["doc_id"].eqNullSafe(hits["d"]) & spanned["th"].eqNullSafe(hits["h"])
    return spanned.join(hits, key, "left").select("doc_id", "th", "base", F.coalesce("terms", none).alias("terms"))


def named(spans: Column, kind) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["stop"].cast("string")))


def kind_of(s: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["k"] + 1)


def sanitize(docs: DataFrame, generalise: bool = True, **how) -> DataFrame:
    """``docs`` with its spans replaced by placeholders (or removed); the other columns stay.

    Spans belong to a row's own text: rows that share a doc_id are told by it.
    """
    found = find_spans(docs.select("doc_id", "text"), **how).dropDuplicates(["doc_id", "th"])
    spans = F.sort_array(
        F.concat(
            F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.upper(kind_of(s)).alias("k"))),
            F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit("TERM").alias("k"))),
        )
    )
    found = found.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), spans.alias("spans"))
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = packed.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & F.xxhash64("text").eqNullSafe(F.col("h")), "left")
    put = (lambda k: F.concat(F.lit("["), k, F.lit("]"))) if generalise else (lambda k: F.lit(""))
    text = F.col("text")
    ends = F.transform("spans", lambda s: s["stop"])
    before = let(ends, lambda x: _running(x, lambda a, y: F.greatest(a, y), F.lit(0)))

    # overlapping spans are taken as they come; what an earlier one covers is not put twice
    def piece(s: Column, at: Column) -> Column:
        gap = F.when(s["start"] > at, F.substring(text, at + 1, s["start"] - at)).otherwise(F.lit(""))
        return F.when(s["stop"] <= at, F.lit("")).otherwise(F.concat(gap, put(s["k"])))

    pieces = F.array_join(F.zip_with("spans", before, piece), "")
    whole = F.concat(pieces, F.substring(text, F.array_max(ends) + 1, F.length(text)))
    clean = F.when(F.size("spans") > 0, whole).otherwise(text)
    return joined.select(*[(clean if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
