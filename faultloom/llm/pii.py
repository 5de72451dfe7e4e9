"""Personal data: patterns, and terms that disclose them by what the corpus says about co-occurrence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultloom.llm.common import staged, unused, written

KINDS = ("email", "ip", "card", "phone")
# Each matches what the plain pattern of its kind matches: look-behinds only forbid starts that an earlier start
# would have covered, possessive repeats only forbid backtracking that cannot help. Both keep matching linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Only whole runs of 14 to 19 digits: text full of shorter numbers has no matches to place.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A term: a word that begins with a letter, with nothing of a word on either side.
TERM = r"(?<=[^\p{L}\p{N}_'-])\p{L}[\p{L}\p{N}_'-]*+(?=[^\p{L}\p{N}_'-])"
#: A term discloses an entity if both meet in at least so many different texts, and if seeing the term gives away
#: at least this share of the entity's information content even at the lower bound of its probability, which lies
#: this many standard errors down.
MIN_TOGETHER, DISCLOSURE, CERTAINTY = 2, 0.8, 1.0
#: Spans whose places are summed in one go.
PIECES = 64
#: Terms of a text up to which only they are placed in it.
ALTERNATIVES = 64
#: Terms up to this number are broadcast to the documents; more are joined by a shuffle, with the same result.
BROADCAST_TERMS = 200_000

SPAN = "struct<start:int,rank:int,end:int,match:string>"


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a text of digits fits."""
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    each = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(doubled(d.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return n.between(14, 19) & _luhn(digits) if kind == "card" else n.between(10, 15)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _placed(pieces: Column, rank: int, offset: int) -> Column:
    """Array of spans of pieces (gap, match), by running sums of their lengths from `offset`.

    Sums and arrays are built for PIECES at a time and then put together, so the work grows with the text.
    """
    none = F.array().cast(f"array<{SPAN}>")
    width = lambda c: F.aggregate(c, F.lit(0), lambda at, p: at + p["gap"] + F.length(p["match"]))

    def step(acc: Column, piece: Column) -> Column:
        start = acc["at"] + piece["gap"]
        end = start + F.length(piece["match"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), piece["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def begin(chunks: Column) -> Column:
        zero = F.struct(F.lit(offset).alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(chunks, zero, lambda acc, c: F.struct((acc["at"] + width(c)).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))["all"]

    spans = lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("spans")), step)["spans"]
    chunks = F.transform(F.sequence(F.lit(1), F.size(pieces), F.lit(PIECES)), lambda i: F.slice(pieces, i, PIECES))
    return _let(chunks, lambda c: F.flatten(F.zip_with(c, begin(c), spans)))


def _spans(text: Column, pattern: str | Column, rank: int, offset: int = 0) -> Column:
    """Array of (start, rank, end, match) of all matches; code points from `offset`, end exclusive.

    The pieces between matches and the matches alternate, so running sums of their lengths give the places.
    """
    def of(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern), F.lit(1), F.size(found))
        pieces = F.zip_with(gaps, found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("match")))
        return F.when(F.size(found) > 0, _let(pieces, lambda p: _placed(p, rank, offset))).otherwise(F.array().cast(f"array<{SPAN}>"))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def base_spans(text: Column) -> Column:
    """Array of (start, rank, end, match) of the valid e-mail, IP, card and phone matches, by start, then kind."""
    valid = lambda kind, spans: F.filter(spans, lambda s: _valid(kind, s["match"]))
    each = [valid(k, _spans(text, PATTERNS[k], r)) for r, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*each))


def _terms(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(TERM), F.lit(0)), F.lower))


def _term_spans(text: Column, terms: Column) -> Column:
    """Array of spans of a text, among them those of the given terms (in lower case); their match is in lower case.

    Up to ALTERNATIVES terms are the alternatives of one pattern; with more, trying them all at every word would take
    longer than placing every word. Either way other words may be placed too (a few letters match ignoring case but
    differ in lower case), so callers compare the match.
    """
    # Of all letters, only this one has a lower case of two code points, which no pattern matches ignoring case.
    either = F.replace(F.array_join(terms, "|"), F.lit("i\u0307"), F.lit("(?:i\u0307|\u0130)"))
    pattern = F.concat(F.lit(r"(?iu)(?<=[^\p{L}\p{N}_'-])(?:"), either, F.lit(r")(?=[^\p{L}\p{N}_'-])"))
    spans = _spans(F.concat(F.lit(" "), text, F.lit(" ")), F.when(F.size(terms) <= ALTERNATIVES, pattern).otherwise(F.lit(TERM)), len(KINDS), -1)
    return F.transform(spans, lambda s: s.withField("match", F.lower(s["match"])))


def _outside(spans: Column) -> Column:
    """Sorted spans without the terms that begin inside a span of a pattern."""
    begin = F.struct(F.lit(0).alias("reach"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        pattern = s["rank"] < len(KINDS)
        kept = F.when(pattern | (s["start"] >= acc["reach"]), F.concat(acc["spans"], F.array(s))).otherwise(acc["spans"])
        return F.struct(F.when(pattern, F.greatest(acc["reach"], s["end"])).otherwise(acc["reach"]).alias("reach"), kept.alias("spans"))

    return F.aggregate(spans, begin, step)["spans"]


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with every span generalised to its kind in brackets; spans that begin inside another go with it."""
    names = F.array(*[F.lit(k.upper()) for k in (*KINDS, "term")])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        out = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.element_at(names, s["rank"] + 1), F.lit("]"))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.when(fresh, s["end"]).otherwise(F.greatest(acc["at"], s["end"])).alias("at"), F.when(fresh, out).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, zero, step)
    return F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text)))


def lower_share(both: Column, of: Column, certainty: float) -> Column:
    """Lower bound of the probability behind `both` of `of` (Wilson's interval, one side)."""
    z2 = F.lit(certainty * certainty)
    p = both / of
    spread = F.lit(certainty) * F.sqrt(p * (1 - p) / of + z2 / (4 * of * of))
    return (p + z2 / (2 * of) - spread) / (1 + z2 / of)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", together: int = MIN_TOGETHER,
                  disclosure: float = DISCLOSURE, certainty: float = CERTAINTY) -> DataFrame:
    """Per document: doc_id, uid (hash of identifier and text), spans (array of start, rank, end, match) and base (those of the patterns).

    Protected entities are the values the patterns find. A term t tells log2 of p(c | t) / p(c) bits about an
    entity c, of the log2 of 1 / p(c) bits there are. Probabilities are shares of the different texts (copies
    of a text say nothing new): p(c) of all of them, p(c | t) of those with the term, at the lower bound of a
    confidence interval, so that few texts prove less than many. Every occurrence of a term above the threshold
    gets a span of kind "term", in all documents, but not inside a span of a pattern.

    Entities of the same texts are counted as one. A term of n texts can only tell enough about an entity of m
    if n <= N ** (1 - disclosure) * m ** disclosure, as both meet in at most m; other terms are left out before
    they are paired, which changes no result.

    NULL texts count as empty; rows that agree in identifier and text share one result. Very long texts are
    worked through once, in time that grows with their length; spans are sorted by start, then kind, so there are
    no ties. Other columns are ignored; an empty table gives no rows. Only DataFrame functions are used.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    rows = rows.withColumn("uid", F.xxhash64("doc_id", "t"))
    found = written(rows.select(
        "doc_id", "uid", F.monotonically_increasing_id().alias("row"), F.struct(F.xxhash64("t").alias("a"), F.xxhash64(F.lit(1), "t").alias("b")).alias("same"),
        base_spans(F.col("t")).alias("base"), _terms(F.col("t")).alias("terms")))

    # Of equal texts, one row is evidence. Rows are joined by their number, so a frequent text is no frequent key.
    first = found.groupBy("same").agg(F.min("row").alias("row")).select("row")
    copies = written(found.select("row").join(first, "row", "left_anti"))
    texts = found.join(copies, "row", "left_anti")

    holding = texts.where(F.size("base") > 0)
    value = F.array_distinct(F.transform("base", lambda s: F.concat(s["rank"].cast("string"), F.lit(":"), s["match"])))
    values = holding.select("uid", F.explode(value).alias("entity")).groupBy("entity", "uid").agg(F.count("*").alias("times"))
    mark = lambda seed: F.sum(F.xxhash64(F.lit(seed), "uid").cast("decimal(20,0)"))
    sets = values.groupBy("entity").agg(F.count("*").alias("n_entity"), mark(1).alias("a"), mark(2).alias("b")).where(F.col("n_entity") >= together)
    sets = staged(values.join(sets, "entity").select(F.struct("n_entity", "a", "b").alias("set"), "n_entity", "uid").distinct())

    total = F.lit(float(max(texts.count(), 1)))
    # A little above the bound, for rounding: told and content decide.
    bound = lambda m: F.pow(total, F.lit(1 - disclosure)) * F.pow(m, F.lit(disclosure)) * 1.001
    most = F.lit(float(sets.agg(F.max("n_entity")).first()[0] or 0))
    of_term = texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_term")).where(
        (F.col("n_term") >= together) & (F.col("n_term") <= bound(most)))
    near = holding.select("uid", F.explode("terms").alias("term")).join(of_term, "term").join(sets, "uid").where(F.col("n_term") <= bound(F.col("n_entity")))
    pairs = near.groupBy("set", "term").agg(F.count("*").alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    content = F.log2(total / F.col("n_entity"))
    told = F.log2(total / F.col("n_entity") * lower_share(F.col("n_both"), F.col("n_term"), certainty))
    disclosing = staged(pairs.where((F.col("n_both") >= together) & (content > 0) & (told >= content * disclosure)).select("term").distinct())

    few = disclosing.count() <= BROADCAST_TERMS
    told_by = F.broadcast(disclosing) if few else disclosing
    holders = found.select("uid", F.explode("terms").alias("term")).join(told_by, "term").groupBy("uid").agg(F.collect_set("term").alias("terms"))
    places = rows.join(holders, "uid").select("uid", F.explode(_term_spans(F.col("t"), F.col("terms"))).alias("span"))
    added = places.withColumn("term", F.col("span.match")).join(told_by, "term").groupBy("uid").agg(F.collect_set("span").alias("added"))
    out = found.select("doc_id", "uid", "base").join(added, "uid", "left")
    return out.select("doc_id", "uid", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(_outside(F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>")))))).alias("spans"))


def digest(spans: DataFrame) -> DataFrame:
    """Counts of each kind, the hash of the pattern spans, and all spans as text."""
    count = lambda r: F.size(F.filter("base", lambda s: s["rank"] == r)).cast("long")
    return spans.select("doc_id", *[count(r).alias(f"n_{k}") for r, k in enumerate(KINDS)],
                        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text redacted."""
    uid, found = (unused(docs.columns, name) for name in ("uid", "spans"))
    spans = personal_data(docs, id_col, text_col).select(F.col("uid").alias(uid), F.col("spans").alias(found)).dropDuplicates([uid])
    key = unused([*docs.columns, uid, found], "key")
    both = docs.withColumn(key, F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    both = both.join(spans, F.col(key) == F.col(uid))
    return both.withColumn(text_col, redacted(F.col(text_col), F.col(found))).select(*[F.col(f"`{c}`") for c in docs.columns])
