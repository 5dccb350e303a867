"""Cross-site boilerplate lines by distinct-site spread.

Each line hash gets a HyperLogLog sketch of the sites that carry it; sketches merge in the aggregation, so a line on every page is
a few partial sketches. Estimates far from the threshold decide; lines near it get an exact distinct count.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelyard.llm._shared import small_batches, values_of, write_table

#: Sites from which a line is boilerplate, words that it must have, and precision of the sketches.
MIN_SITES = 10
MIN_WORDS = 4
LG_K = 9
#: Estimates within this share of the threshold (and one site at least) are counted exactly.
BAND = 0.25
#: Characters that end words and are trimmed from lines.
SPACES = " \t\n\x0b\x0c\r"
#: Boilerplate lines up to this number (some 20 MB) are sent to every executor; beyond it their positions are joined.
SENT_LINES = 100_000


#: What a row's positions go by: rows alike in id and text lose the same lines.
ROW = ["doc_id", "t1", "t2"]


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_words: int) -> DataFrame:
    """One row per line of at least ``min_words`` words: id, the whole text's 128-bit hash, position, the trimmed line's 128-bit hash, site."""
    text = F.col(text_col)
    split = docs.select(F.col(id_col).alias("doc_id"), *_text_key(text), F.col(site_col).alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "raw"))
    # A trimmed line ends in a word, so only the words before it need matching; the pattern stops at the last one asked for.
    long_enough = F.col("line").rlike(rf"^(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{max(0, min_words - 1)}}}[^\x20\x09-\x0D]")
    return (
        split.withColumn("line", F.btrim("raw", F.lit(SPACES)))
        .where(long_enough)
        .select(*ROW, "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    )


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def line_spread(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """``(h1, h2, sites, first_id)`` of the lines that at least ``min_sites`` distinct sites carry; first_id: the smallest document id.

    A null site is no site. Lines under ``min_words`` words are left out: short phrases recur by chance.
    """
    lines = _lines(docs, id_col, text_col, site_col, min_words)
    merged = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.count("site").alias("n"), F.min("doc_id").alias("first_id")
    )
    # A line has no more sites than occurrences, which is exact and spares estimates.
    frequent = merged.where(F.col("n") >= min_sites).select("h1", "h2", "first_id", F.hll_sketch_estimate("sketch").alias("estimate"))
    band = max(1.0, BAND * min_sites)
    judged = write_table(frequent.where(F.col("estimate") >= min_sites - band), "line-spread")
    near = F.abs(F.col("estimate") - min_sites) <= band
    sure = judged.where(~near).select("h1", "h2", F.col("estimate").alias("sites"), "first_id")
    doubtful = judged.where(near)
    pairs = lines.join(doubtful.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct()
    exact = pairs.groupBy("h1", "h2").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    return sure.union(exact.join(doubtful.select("h1", "h2", "first_id"), ["h1", "h2"]).select("h1", "h2", "sites", "first_id"))


def boilerplate_positions(docs: DataFrame, spread: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, t1, t2, drop array<int>)``: positions of boilerplate lines by id and text hash; the document with the smallest id keeps its first one."""
    lines = _lines(docs, id_col, text_col, site_col, min_words)
    held = lines.join(spread.select("h1", "h2", "first_id"), ["h1", "h2"])
    own = F.col("doc_id").eqNullSafe(F.col("first_id"))
    kept_first = held.where(own).groupBy(*ROW, "h1", "h2").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    again = kept_first.select(*ROW, F.explode(F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(1)))).alias("pos"))
    gone = held.where(~own).select(*ROW, "pos").union(again)
    return gone.groupBy(*ROW).agg(F.sort_array(F.collect_set("pos")).alias("drop"))


def clean_text(text: Column, drop: Column) -> Column:
    """The text without the lines at the given positions."""
    kept = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(drop, i))
    return F.when(drop.isNull(), text).otherwise(F.array_join(kept, "\n"))


def _cutter(lines):
    """An Arrow function ``(id, text) -> (text, removed lines)`` over the broadcast boilerplate ``{h1: {h2: first_id}}``; no text if it loses nothing."""
    seed = second_seed()

    def cut(doc_id, text: bytes, known: dict) -> tuple[bytes | None, int]:
        raw, kept, seen = text.split(b"\n"), [], set()
        for line in raw:
            bare = line.strip()
            found = known.get(xxhash.xxh64_intdigest(bare, 42))
            if found is not None:
                h2 = xxhash.xxh64_intdigest(bare, seed)
                if h2 in found and (found[h2] != doc_id or bare in seen):
                    continue
                seen.add(bare)
            kept.append(line)
        return (b"\n".join(kept), len(raw) - len(kept)) if len(kept) < len(raw) else (None, 0)

    def run(ids: pa.Array, texts: pa.Array) -> pa.Array:
        known = lines.value
        done = [(None, 0) if t is None else cut(i, t, known) for i, t in zip(values_of(ids), values_of(texts), strict=True)]
        parts = pa.array([t for t, _ in done], pa.binary()), pa.array([n for _, n in done], pa.int32())
        return pa.StructArray.from_arrays(list(parts), ["text", "removed"])

    return run


def second_seed() -> int:
    """Spark chains the hashes of several columns: that of the integer 1 seeds that of the line."""
    return xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, sent_lines: int = SENT_LINES) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text`` and a column ``removed_lines`` (int), which takes the place of one of that name.

    Lines are compared trimmed; case counts. Sites are counted exactly near the threshold, elsewhere estimated. Of each boilerplate line the occurrence in the
    document with the smallest id stays. Null texts stay null; a null id is an id like any other; repeated rows lose the same lines; other columns are kept
    as they are, whatever their names. An empty table gives an empty result. Up to ``sent_lines`` boilerplate lines are broadcast and cut beside each row, so
    that no text is shuffled; with more, line positions are joined to the documents by id and text hash, with the same result.
    """
    small_batches(docs.sparkSession)
    spread = write_table(line_spread(docs, id_col, text_col, site_col, min_sites, min_words), "boilerplate")
    row = F.struct(*[F.col(_quoted(c)) for c in docs.columns]).alias("row")
    doc_id, text = F.col("row").getField(id_col), F.col("row").getField(text_col)
    if spread.limit(sent_lines + 1).count() <= sent_lines:
        lines: dict[int, dict] = {}
        for r in spread.select("h1", "h2", "first_id").toLocalIterator():
            lines.setdefault(r.h1 % (1 << 64), {})[r.h2 % (1 << 64)] = r.first_id
        cut = F.arrow_udf(_cutter(docs.sparkSession.sparkContext.broadcast(lines)), "struct<text: binary, removed: int>")
        done = docs.select(row, cut(F.col(_quoted(id_col)), F.col(_quoted(text_col)).cast("binary")).alias("cut"))
        # Texts that lost nothing are passed on as they came, not by way of Python.
        cleaned, removed = F.when(F.col("cut.removed") > 0, F.col("cut.text").cast("string")).otherwise(text), F.col("cut.removed")
    else:
        drop = boilerplate_positions(docs, spread, id_col, text_col, site_col, min_words)
        keyed = docs.select(row).withColumns(dict(zip(("k1", "k2"), _text_key(text), strict=True)))
        same = doc_id.eqNullSafe(F.col("doc_id")) & (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2"))
        done = keyed.join(drop, same, "left")
        cleaned, removed = clean_text(text, F.col("drop")), F.coalesce(F.size("drop"), F.lit(0))
    others = [c for c in docs.columns if c.lower() != "removed_lines"]
    return done.select(*((cleaned if c == text_col else F.col("row").getField(c)).alias(c) for c in others), removed.alias("removed_lines"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
