"""Batch search: a table of queries against the postings.

Queries are rows ``query_id, field, value``. Broadcasting is left to Spark,
which does it when the query side is measured small; a hot term is split by
adaptive skew handling of the join or by the salts below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.catalog import Catalog
from fieldloom.functions.fields import (
    by_field,
    has_wildcard,
    like_pattern,
    literal_prefix,
    query_term,
    wildcard_match,
    wildcard_regex,
)
from fieldloom.session import written

SALTS = 16
#: Lengths of the beginnings and ends a pattern can be joined on.
AFFIXES = (8, 4, 2, 1)
#: Lengths of the runs within a term a pattern without either can be joined on.
GRAMS = (3, 2, 1)


def query_terms(queries: DataFrame, catalog: Catalog) -> DataFrame:
    """Add ``term, wildcard``; rows without a usable term are dropped."""
    known = queries.where(F.col("field").isin(*[spec.name for spec in catalog.indexed]))
    term = by_field(catalog, F.col("field"), lambda s: query_term(s, F.col("value")))
    # As output of a generator the term is computed once: filters on it, also
    # those Spark infers from joins, are not rewritten in terms of the value.
    termed = known.select("*", F.explode_outer(F.array(term)).alias("term"))
    return termed.where(F.col("term").isNotNull()).withColumn("wildcard", has_wildcard(F.col("term")))


def exact_hits(postings: DataFrame, terms: DataFrame, salts: int = SALTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Hits of exact terms: ``query_id, doc_id, source_table``, with the columns of ``terms`` in ``keep``.

    Postings of one term are spread over ``salts`` join keys, so a term that
    holds a third of all postings fills that many tasks, not one.
    """
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    wanted = terms.where(~F.col("wildcard")).select("query_id", *keep, "field", "term", spread)
    salted = postings.select(
        "field", "term", "doc_id", "source_table", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt")
    )
    return salted.join(wanted, ["field", "term", "salt"]).select("query_id", "doc_id", "source_table", *keep)


def of_fields(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of the fields some query asks for.

    There are no more field names than the catalogue has, so they are broadcast;
    over a stored index this prunes the partitions of all other fields.
    """
    return postings.join(F.broadcast(terms.select("field").distinct()), "field", "left_semi")


def vocabulary(postings: DataFrame) -> DataFrame:
    """The distinct terms per field; counting combines on the map side."""
    return postings.select("field", "term").distinct()


def _affix_size(text: Column) -> Column:
    """The greatest length in ``AFFIXES`` that fits, 0 for an empty text."""
    size = F.lit(0)
    for n in reversed(AFFIXES):
        size = F.when(F.length(text) >= n, n).otherwise(size)
    return size


def _magnitude(length: Column) -> Column:
    return F.floor(F.log2(length)).cast("int")


def pattern_keys(patterns: DataFrame) -> DataFrame:
    """Add ``kind, key``: what a term must hold to match the pattern in ``term``.

    The beginning before the first wildcard, else the end behind the last one, else
    three characters of the longest run between wildcards, or fewer where it is
    shorter. A pattern of wildcards alone is matched by lengths: it gets a row for
    each power of two that a matching term's length can lie at.
    """
    text = F.col("term")
    rows = patterns.withColumns(
        {
            "_head": literal_prefix(text),
            "_tail": F.reverse(F.regexp_extract(text, r"[^?%]+\z", 0)),
            "_run": F.array_max(F.transform(F.split(text, "[?%]"), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"],
            "_least": F.length(F.replace(text, F.lit("%"))),
        }
    )
    head, tail, gram = _affix_size(F.col("_head")), _affix_size(F.col("_tail")), F.least(F.length("_run"), F.lit(GRAMS[0]))
    low = _magnitude(F.greatest("_least", F.lit(1)))
    sizes = F.sequence(low, F.when(text.contains("%"), 31).otherwise(low))

    def one(kind: str, size: Column, source: str) -> Column:
        kinds = F.concat(F.lit(kind), size.cast("string"))
        return F.array(F.struct(kinds.alias("kind"), F.expr(f"substring({source}, 1, _size)").alias("key")))

    rows = rows.withColumn("_size", F.when(head > 0, head).when(tail > 0, tail).otherwise(gram))
    keys = (
        F.when(head > 0, one("head", F.col("_size"), "_head"))
        .when(tail > 0, one("tail", F.col("_size"), "_tail"))
        .when(F.col("_run") != "", one("gram", F.col("_size"), "_run"))
        .otherwise(F.transform(sizes, lambda n: F.struct(F.lit("length").alias("kind"), n.cast("string").alias("key"))))
    )
    return rows.select(*patterns.columns, F.inline(keys))


def _runs(text: Column, n: int) -> Column:
    """All runs of ``n`` characters of a text that has as many."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))


def word_keys(words: DataFrame, kinds: list[str]) -> DataFrame:
    """Add ``kind, key`` to rows with a ``term``: a row for each key of the given kinds.

    Only the kinds that some pattern asks for are made, so prefixes do not pay for
    what runs in the middle cost.
    """
    text, made = F.col("term"), []
    back = F.reverse(text)

    def several(kind: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    for n in AFFIXES:
        for name, source in (("head", text), ("tail", back)):
            if f"{name}{n}" in kinds:
                made.append(several(f"{name}{n}", F.when(F.length(text) >= n, F.array(F.substring(source, 1, n)))))
    for n in GRAMS:
        if f"gram{n}" in kinds:
            made.append(several(f"gram{n}", F.when(F.length(text) >= n, F.array_distinct(_runs(text, n)))))
    if "length" in kinds:
        made.append(several("length", F.when(F.length(text) > 0, F.array(_magnitude(F.length(text)).cast("string")))))
    empty = F.array().cast("array<struct<kind:string,key:string>>")
    listed = F.concat(empty, *[F.coalesce(m, empty) for m in made])
    return words.select(*words.columns, F.inline(listed))


def matched_terms(terms: DataFrame, words: DataFrame, keep: tuple[str, ...] = (), salts: int = SALTS) -> DataFrame:
    """Terms of ``words`` each wildcard query matches, with the columns in ``keep``.

    An equi-join on a piece of text that every match must hold proposes the pairs and
    LIKE decides. The salt splits a piece that very many terms hold.
    """
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    patterns = pattern_keys(terms.where("wildcard").select("query_id", "field", "term").distinct())
    # The kinds are a fixed handful, and the fields those of the catalogue.
    asked = patterns.select("field", "kind").distinct().collect()
    kinds, fields = ({r[name] for r in asked} for name in ("kind", "field"))
    words = words.where(F.col("field").isin(sorted(fields)))
    patterns = patterns.select(
        "query_id",
        "field",
        like_pattern(F.col("term")).alias("pattern"),
        wildcard_regex(F.col("term")).alias("regex"),
        literal_prefix(F.col("term")).alias("prefix"),
        F.col("term").alias("line"),
        "kind",
        "key",
        spread,
    )
    salt = F.pmod(F.xxhash64("term", *keep), F.lit(salts)).cast("int").alias("salt")
    keyed = word_keys(words.select("field", "term", *keep, salt), sorted(kinds))
    pairs = keyed.join(patterns, ["field", "kind", "key", "salt"])
    # The whole prefix is compared before a pattern is compiled.
    pairs = pairs.where(F.startswith(F.col("term"), F.col("prefix")))
    matched = pairs.where(wildcard_match(F.col("term"), F.col("pattern"), F.col("regex")))
    return matched.select("query_id", "field", "line", "term", *keep)


def wildcard_hits(
    postings: DataFrame, terms: DataFrame, salts: int = SALTS, words: DataFrame | None = None
) -> DataFrame:
    """Hits of wildcard terms. A document is reported once per query.

    ``words`` are the distinct terms, if they are stored; they may be more.
    """
    known = vocabulary(of_fields(postings, terms.where("wildcard"))) if words is None else words
    matched = matched_terms(terms, known, salts=salts).select("query_id", "field", "term").distinct()
    as_exact = matched.withColumn("wildcard", F.lit(False))
    return exact_hits(postings, as_exact, salts).distinct()


def batch_search(
    postings: DataFrame, queries: DataFrame, catalog: Catalog, salts: int = SALTS, words: DataFrame | None = None
) -> DataFrame:
    """Hits of every query, exact and wildcard alike, each line for itself."""
    terms = query_terms(queries, catalog)
    exact = exact_hits(postings, terms, salts).distinct()
    return exact.unionByName(wildcard_hits(postings, terms, salts, words))


def batch_and(
    postings: DataFrame, queries: DataFrame, catalog: Catalog, salts: int = 1, words: DataFrame | None = None
) -> DataFrame:
    """Documents that meet all lines of a query: ``query_id, doc_id, source_table``.

    Queries are rows ``query_id, field, value``, several of one ``query_id``. Lines
    of which nothing remains are dropped, so the query widens, as a single search
    does; equal lines count once. A line may match many terms and a field may stand in
    several lines.

    It is a division: a document is found when it meets as many distinct lines as the
    query has. Terms are matched and counted per distinct line, however many queries hold
    it. Hits of a line that half of all documents meet are never made per
    query: each query's rarest line proposes its documents, and of those alone the
    other lines are checked, by the terms the documents hold. Adaptive joins split a
    hot term, as all tables here are at rest; ``salts`` would multiply the lines.
    """
    lines = query_terms(queries, catalog).select("query_id", "field", F.col("term").alias("line"), "wildcard").distinct()
    lines = written(lines, "batch-queries")
    asked = lines.select(F.lit(0).alias("query_id"), "field", F.col("line").alias("term"), "wildcard").distinct()
    exact = asked.where(~F.col("wildcard")).select("field", F.col("term").alias("line"), "term")
    known = vocabulary(of_fields(postings, asked.where("wildcard"))) if words is None else words
    matched = matched_terms(asked, known, salts=SALTS).select("field", "line", "term")
    wanted = written(exact.unionByName(matched), "batch-lines")

    # Postings of some wanted term, each once, whatever the number of queries.
    keys = wanted.select("field", "term").distinct()
    met = postings.select("field", "term", "doc_id", "source_table").join(keys, ["field", "term"], "left_semi")
    met = written(met, "batch-postings")

    counts = met.groupBy("field", "term").agg(F.count("*").alias("n"))
    sizes = wanted.join(counts, ["field", "term"]).groupBy("field", "line").agg(F.sum("n").alias("n"))
    # Lines that no posting meets have no size.
    size = F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("field"), F.col("line"))
    per_query = (
        lines.join(sizes, ["field", "line"], "left")
        .groupBy("query_id")
        .agg(F.count("*").alias("lines"), F.min(size).alias("rarest"))
        .where("rarest.n > 0")
    )
    per_query = written(per_query, "batch-rarest")
    rarest = per_query.select("query_id", "lines", F.col("rarest.field").alias("field"), F.col("rarest.line").alias("line"))
    first = wanted.join(rarest, ["field", "line"]).withColumn("wildcard", F.lit(False))
    ids = ["doc_id", "source_table"]
    candidates = exact_hits(met, first, salts, ("lines",)).distinct()
    candidates = written(candidates, "batch-candidates")

    # What is left of each query, and which of it the candidates' own terms meet.
    rest = lines.select("query_id", "field", "line").join(rarest, ["query_id", "field", "line"], "left_anti")
    pairs = candidates.where("lines > 1").join(rest, "query_id")
    held = pairs.join(met, [*ids, "field"]).join(wanted, ["field", "line", "term"], "left_semi")
    # Dealt by query and document, both steps of the count are made in place.
    dealt = held.select("query_id", *ids, "lines", "field", "line").repartition("query_id", *ids)
    found = dealt.distinct().groupBy("query_id", *ids).agg(F.count("*").alias("met"), F.max("lines").alias("lines"))
    several = found.where("met = lines - 1").select("query_id", *ids)
    return candidates.where("lines = 1").select("query_id", *ids).unionByName(several)
