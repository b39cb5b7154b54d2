"""Benchmark passages in training text, found by spaced seeds and verified with substitutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: 1: the token counts; 0: any token may stand there. Of 7 to 20 tokens of which 80 % agree, whichever they are, one mask always fits.
MASKS = ("1101011", "1110101", "11111", "11100101")
#: Shorter passages have masks of their whole length: from 5 tokens on, each leaves out one.
SPAN = 7
SHORT = {n: ("1" * n,) if n < 5 else tuple("1" * i + "0" + "1" * (n - i - 1) for i in range(n)) for n in range(1, SPAN)}
#: Bytes of seeds with their passages that go to every task at once; a larger benchmark is taken in blocks.
BROADCAST_BYTES = 32 << 20


def token_hashes(text: Column) -> Column:
    """Hashes of the runs of letters and digits, in lower case; null for a null text."""
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, tokens: str, masks: tuple[str, ...]) -> DataFrame:
    """A row for each position and mask: ``at`` (from 0) and ``seed``, the hash of the tokens under the mask's ones.

    The positions are exploded, not the tokens: the array stays in its row, and generated code reads from it.
    """
    out = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.size(tokens) - 1)))
    picks = []
    for mask in masks:
        picked = [F.get(F.col(tokens), F.col("at") + i) for i, c in enumerate(mask) if c == "1"]
        picks.append(F.when(F.col("at") + len(mask) <= F.size(tokens), F.xxhash64(*picked, F.lit(int("1" + mask, 2)))))
    return out.withColumn("seed", F.explode(F.array(*picks))).where("seed IS NOT NULL")


def _verified(window: int, share: int) -> Column:
    """Is there a window of the passage, laid over the document at offset ``off``, of which ``share`` hundredths agree?

    The window has ``window`` tokens, or all of a shorter passage, and lies within both texts.
    """
    width = f"least({window}, size(item))"
    equal = "transform(sequence(0, size(item) - 1), k -> if(off + k >= 0 AND get(tok, off + k) = item[k], 1, 0))"
    low, high = "greatest(0, -off)", f"least(size(item), size(tok) - off) - {width}"
    return F.expr(f"if({low} > {high}, false, exists(sequence({low}, {high}), s -> aggregate(slice({equal}, s + 1, {width}), 0, (a, x) -> a + x) * 100 >= {share} * {width}))")


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id) for each document that holds a passage of ``items``; equal doc_ids are one document, null is one too."""
    return contaminated_texts(docs, items, **options).select("doc_id", "item_id").distinct()


def contaminated_texts(docs: DataFrame, items: DataFrame, window: int = 20, share: int = 80, bound: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, digest, item_id) for each doc_id and text that hold a passage of ``items`` (item_id, text); digest is the text's md5.

    A document holds a passage if ``window`` consecutive tokens of it (the whole passage, if shorter) agree
    in ``share`` hundredths of the tokens, position by position; so substituted tokens do no harm. With the given window
    and share no such place is missed: one seed of it always agrees.
    Null and empty texts hold nothing. Texts that share a doc_id, null too, are judged apart.

    Only ids and seeds meet in the join, and the seeds of the benchmark, in blocks of at most ``bound`` bytes, come to the
    documents; the whole texts come back for documents with a hit.
    """
    tests = items.select("item_id", token_hashes(F.col("text")).alias("item")).where(F.size("item") > 0)
    short = sorted(r[0] for r in tests.where(F.size("item") < SPAN).select(F.size("item")).distinct().collect())  # below SPAN values
    seeds = _seeds(tests, "item", MASKS).select("seed", "item_id", "at")
    for n in short:
        seeds = seeds.union(_seeds(tests.where(F.size("item") == n), "item", SHORT[n]).where("at = 0").select("seed", "item_id", "at"))
    seeds = seeds.withColumnRenamed("at", "item_at")
    blocks = -(-(items.agg(F.sum(F.octet_length("text") + 100)).first()[0] or 1) * 16 // bound)
    own = docs.select("doc_id", "text").where("text IS NOT NULL").withColumn("row", F.xxhash64("text"))
    tokens = own.select("doc_id", "row", token_hashes(F.col("text")).alias("tok"))
    asked = _seeds(tokens, "tok", MASKS + tuple(m for n in short for m in SHORT[n])).select("doc_id", "row", "at", "seed")
    met = None
    for block in range(blocks):
        part = seeds if blocks == 1 else seeds.where(F.pmod(F.xxhash64("seed"), F.lit(blocks)) == block)
        found = asked.join(F.broadcast(part), "seed").select("doc_id", "row", "item_id", (F.col("at") - F.col("item_at")).alias("off"))
        met = found if met is None else met.union(found)
    hits = met.distinct().groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_list(F.struct("item_id", "off")).alias("hits"))
    back = own.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")))
    back = back.select("doc_id", F.md5("text").alias("digest"), token_hashes(F.col("text")).alias("tok"), F.explode("hits").alias("hit")).select("doc_id", "digest", "tok", "hit.item_id", "hit.off")
    return back.join(F.broadcast(tests) if blocks == 1 else tests, "item_id").where(_verified(window, share)).select("doc_id", "digest", "item_id").distinct()


def mark_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` with contaminated, n_items and item_ids (sorted, comma-joined); one row for each row. Columns of these names are replaced.

    Each row is judged by its own text, whatever rows share its doc_id or have none.
    """
    found = contaminated_texts(docs, items, **options).groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    found = found.agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_set("item_id")), ",").alias("item_ids"))
    out = docs.drop("contaminated", "n_items", "item_ids").join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.md5("text") == F.col("_digest")), "left").drop("_id", "_digest")
    return out.withColumns({"contaminated": F.col("n_items").isNotNull(), "n_items": F.coalesce("n_items", F.lit(0).cast("long")), "item_ids": F.coalesce("item_ids", F.lit(""))})


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all passages of the benchmark."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return mark_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "contaminated", "n_items", "item_ids")


def _sql_seeds(table: str, tokens: str, keep: str) -> str:
    parts = []
    for mask in (*MASKS, *(m for n in SHORT for m in SHORT[n])):
        n = len(mask)
        whole = mask in SHORT.get(n, ())
        key = " || ' ' || ".join(f"{tokens}[i + {j + 1}]" for j, c in enumerate(mask) if c == "1")
        only = "" if not whole else f" WHERE len({tokens}) = {n}" if table == "tests" else f" WHERE EXISTS (SELECT 1 FROM tests WHERE len(item) = {n})"
        parts.append(f"SELECT {keep}, i AS pos, {int('1' + mask, 2)} AS m, {key} AS seed FROM (SELECT *, unnest(range(len({tokens}) - {n - 1})) AS i FROM {table}{only})")
    return " UNION ALL ".join(parts)


def oracle_parts(docs: str = "documents", window: int = 20, share: int = 80) -> str:
    """CTEs that end in ``leaks`` (doc_id, item_id)."""
    return f"""
tests AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS item FROM benchmark
), toks AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS tok FROM {docs}
), iseeds AS ({_sql_seeds('tests', 'item', 'item_id, item')}
), dseeds AS ({_sql_seeds('toks', 'tok', 'doc_id, tok')}
), met AS (SELECT doc_id, tok, item_id, item, d.pos, i.pos AS item_pos, least({window}, len(item)) AS width FROM dseeds d JOIN iseeds i USING (m, seed)
), offs AS (SELECT DISTINCT doc_id, tok, item_id, item, pos - item_pos AS off, width FROM met
), starts AS (SELECT *, unnest(range(greatest(0, -off), least(len(item), len(tok) - off) - width + 1)) AS s FROM offs
), leaks AS (SELECT DISTINCT doc_id, item_id FROM starts
  WHERE len(list_filter(range(s, s + width), lambda k: tok[off + k + 1] = item[k + 1])) * 100 >= {share} * width)"""


ORACLE = f"""WITH {oracle_parts()}
SELECT d.doc_id, n IS NOT NULL AS contaminated, coalesce(n, 0) AS n_items, coalesce(ids, '') AS item_ids
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS ids FROM leaks GROUP BY doc_id) l USING (doc_id)"""
