"""Divergence of sources within a language, by their terms, in integers.

A language keeps the V terms of at least `min_docs` of its documents. A group (lang,
source) or a language gives a term of count c the share
p = 1 + floor(UNIT * (c + 2) / (N + 2 V)), N its count of all kept terms. Two groups
differ by the sum over all kept terms of f(p, q) = floor((p - q)^2 / (p + q)).

Few of the V terms occur in a group, so no row is made for those that don't. Counts
are sparse postings, and a pair's sum is put together by inclusion and exclusion over
the supports A and B, with p0 and q0 the shares of count 0:

    sum = [A against q0] + [B against p0] - V f(p0, q0)
          + sum over A and B both of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

A group's side costs one term for each different share of its histogram (all terms
that don't occur are one bin) and each different q0 of its language, not for each
other group. Only terms that two groups share are met, in a join of the postings by
term; a term of many sources is dealt by source to several tasks.

Words are counted in the tasks that read the text, by group and term, before anything
is shuffled; texts never are. No row is kept of a document.

Defined cases: null lang, source or text count as ''. A group without kept terms has
N = 0 and takes part in pairs; a language that keeps none gives pairs of value 0 and
no terms. Rows that repeat count each. Terms are runs of letters and non-ASCII
characters, A-Z alone lowered. Texts of any length are read whole, in pieces that end
between terms. Ties go by the item's UTF-8 bytes. An empty table gives no rows. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanlake.llm.common import drop_table, materialize, read, small_batches, trimmed

UNIT = 1_000_000_000
MIN_DOCS = 10
TOP = 10
#: Different terms and documents of which a task hands on its counts at once.
HELD = 400_000
#: Bytes of a text whose terms are listed at once.
PIECE = 1 << 20
#: Groups of a language, and postings of a term, that one task sets against all.
SHARE = 64
POSTINGS = 512


def _pieces(raw: bytes, gap: re.Pattern):
    at = 0
    while len(raw) - at > PIECE:
        cut = gap.search(raw, at + PIECE)
        if cut is None:
            break
        yield raw[at : cut.start()]
        at = cut.start()
    yield raw[at:] if at else raw


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); a null term
    for each group that occurs."""
    small_batches(docs.sparkSession, 1000, "4m")

    def count(batches):
        term, gap = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
        lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def out():
            cols: list = [[] for _ in range(5)]
            for (lang, source), (n, docs) in held.items():
                for c, x in zip(cols, ([lang], [source])):
                    c += x * (len(n) + 1)
                cols[2] += [*n, None]
                cols[3] += [*n.values(), 0]
                cols[4] += [*map(docs.__getitem__, n), 0]
            held.clear()
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["lang", "source", "term", "n", "docs"])

        size = 0
        for b in batches:
            for g, text in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), b.column(2)):
                n, docs = held.setdefault(g, (Counter(), Counter()))
                before, seen = len(n), set()
                for piece in _pieces(text.as_buffer().to_pybytes().translate(lower), gap):
                    found = term.findall(piece)
                    n.update(found)
                    seen.update(found)
                docs.update(seen)
                size += len(n) - before + 1
            if size > HELD:
                size = 0
                yield out()
        if held:
            yield out()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = rows.mapInArrow(trimmed(count), "lang string, source string, term binary, n long, docs long")
    counted = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return counted.withColumn("term", F.col("term").cast("string"))


def share(count: str, total: str, v: str) -> F.Column:
    """In decimals: a count times UNIT may not fit a long."""
    return F.expr(f"cast({UNIT} as decimal(10,0)) * cast({count} + 2 as decimal(20,0)) div cast({total} + 2 * {v} as decimal(20,0)) + 1")


def gap(p: str, q: str) -> F.Column:
    """f(p, q)."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def pair_sums(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, a, b, value of every two groups a < b of a language. `groups`: lang,
    source, zero (share of count 0), v, support (terms that occur); `postings`: lang,
    source, term, p, zero, sources (groups in which the term occurs)."""
    n = groups.count()
    salts = max(1, n // SHARE)
    salt, all_salts = F.pmod(F.xxhash64("source"), F.lit(salts)), F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))

    none = groups.select("lang", "source", F.col("zero").alias("p"), (F.col("v") - F.col("support")).alias("n"))
    bins = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("n")).unionByName(none).withColumn("salt", salt)
    zeros = groups.select("lang", F.col("zero").alias("q")).distinct().withColumn("salt", all_salts)
    one_sided = bins.join(zeros, ["lang", "salt"]).groupBy("lang", "source", "q").agg(F.sum(F.col("n") * gap("p", "q")).alias("cost"))
    one_sided = materialize(one_sided)

    shared = postings.withColumn("salts", F.expr(f"sources div {POSTINGS} + 1"))
    left = shared.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("zero").alias("za"), F.pmod(F.xxhash64("source"), "salts").alias("salt"))
    right = shared.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("zero").alias("zb"), F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"))
    both = left.join(right, ["lang", "term", "salt"]).filter("a < b")
    overlap = both.groupBy("lang", "a", "b").agg(F.sum(gap("pa", "pb") - gap("pa", "zb") - gap("za", "pb") + gap("za", "zb")).alias("overlap"))

    left = groups.select("lang", F.col("source").alias("a"), F.col("zero").alias("za"), "v", salt.alias("salt"))
    right = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("zb"), all_salts.alias("salt"))
    pairs = left.join(right, ["lang", "salt"]).filter("a < b").drop("salt")
    pairs = pairs.join(one_sided.select("lang", F.col("source").alias("a"), F.col("q").alias("zb"), F.col("cost").alias("x")), ["lang", "a", "zb"])
    pairs = pairs.join(one_sided.select("lang", F.col("source").alias("b"), F.col("q").alias("za"), F.col("cost").alias("y")), ["lang", "b", "za"])
    pairs = pairs.join(overlap, ["lang", "a", "b"], "left")
    return pairs.select("lang", "a", "b", (F.col("x") + F.col("y") - F.col("v") * gap("za", "zb") + F.coalesce("overlap", F.lit(0))).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: by part `pair` how far each other source of
    the language is, by part `term` the `top` terms that the group has more of than its
    language."""
    counted = materialize(term_counts(docs))
    by_term = counted.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.count("*").alias("sources"))
    kept = materialize(by_term.filter(F.col("docs") >= min_docs).drop("docs"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    held = counted.filter("term is not null").drop("docs").join(kept, ["lang", "term"])
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    groups = counted.filter("term is null").select("lang", "source").join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0)
    # Without terms any share will do: no sum has a part.
    groups = groups.withColumn("zero", F.when(F.col("v") > 0, share("0", "total", "if(v > 0, v, 1)")).otherwise(1))
    groups = materialize(groups)
    postings = held.join(groups.select("lang", "source", "total", "v", "lang_total", "zero"), ["lang", "source"])
    postings = postings.withColumn("p", share("n", "total", "v")).withColumn("q", share("lang_n", "lang_total", "v"))
    postings = materialize(postings.select("lang", "source", "term", "p", "q", "zero", "sources"))
    drop_table(counted)

    pairs = pair_sums(groups, postings)
    sides = F.explode(F.array(*(F.struct(F.col(s).alias("source"), F.col(i).alias("item")) for s, i in (("a", "b"), ("b", "a")))))
    pairs = pairs.select("lang", sides.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    terms = postings.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap("p", "q").alias("value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    # A rank filter drops most terms before they are shuffled.
    terms = terms.withColumn("rank", ranked).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", ranked).unionByName(terms)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), terms AS (SELECT r, lang, source, unnest(w) AS term FROM docs
), kept AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), groups AS (SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT t.lang, t.source, t.term, count(*) AS n FROM terms t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY t.lang, t.source, t.term
), totals AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY lang, source
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.n, 0) + 2 * l.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.n + 2)) // (l.n + 2 * l.v)::HUGEINT AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), found AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
