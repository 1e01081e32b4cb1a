"""Evaluation texts leaking into training text: rare n-gram seeds, then Smith-Waterman alignment.

Texts become words: maximal runs of letters and digits, without regard to case, accents, tags and other markup, punctuation,
spacing and invisible characters. Of every RUN words of an item in a row, the 5-gram that the fewest documents contain is
a seed; a document that contains the run contains the seed, so no run is lost, and common phrases find nobody. Documents
and items that share a seed are aligned word by word, which also scores edited and paraphrased copies.

Null and empty texts have no words; items of fewer than RUN words leak nothing. Repeated documents are reported each.
"""

from __future__ import annotations

import html
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .vectors import shared_dir

GRAM, RUN = 5, 10
#: Alignment scores: a matching word, another word, a skipped word; and words of context around the seeds.
MATCH, MISMATCH, GAP, AROUND = 2, -1, -1, 40
#: Item grams are broadcast up to this many rows (12 bytes each); more are joined by a shuffle.
BROADCAST_GRAMS = 2_000_000
#: Ids of documents that share a seed are broadcast up to this many (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
_INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|span|a|mark|small|big|sub|sup|font|code|tt|abbr|cite|q|del|ins|kbd|wbr)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<(?:/?[a-zA-Z][^<>]*|!--.*?--)>", re.S)
_INVISIBLE = re.compile(r"[\p{Cf}͏︀-️]")
_MOJIBAKE = re.compile(r"[ÂÃ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")
_LINK = re.compile(r"\]\([^()\s]*\)")
_WORDS = re.compile(r"[\p{L}\p{N}]+")


def _mend(m) -> str:
    try:
        return m.group(0).encode("cp1252").decode("utf-8")
    except UnicodeError:
        return m.group(0)


def words(text: str | None) -> list[str]:
    """The words of a text, folded."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "](" in text:
        text = _LINK.sub("] ", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", _MOJIBAKE.sub(_mend, text))
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _WORDS.findall(text.casefold())


def _hashes(ws: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w) for w in ws], np.uint64)


def gram_hashes(ws: list[str]) -> np.ndarray:
    """A 64-bit hash of every GRAM words in a row."""
    if len(ws) < GRAM:
        return np.empty(0, np.int64)
    h = _hashes(ws)
    n = len(h) - GRAM + 1
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def grams(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, pos, gram) of every text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids, pos, out = [], [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    g = gram_hashes(words(text))
                    ids.append(np.full(len(g), key, np.int64))
                    pos.append(np.arange(len(g), dtype=np.int32))
                    out.append(g)
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(pos)), pa.array(np.concatenate(out))], ["id", "pos", "gram"])

    rows = df.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "id bigint, pos int, gram bigint")


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(score, matched words, longest run of equal words) of the best local alignment of two word sequences.

    The run is the longest of the whole table, not only of the best alignment.
    """
    if not len(a) or not len(b):
        return 0, 0, 0
    n = len(b)
    steps = np.arange(n + 1) * -GAP
    h, run = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
    got = np.zeros(n + 1, np.int32)  # matched words of the alignment that ends here
    best, best_got, best_run = 0, 0, 0
    for w in a:
        same = b == w
        diag = h[:-1] + np.where(same, MATCH, MISMATCH)
        up = h[1:] + GAP
        row = np.zeros(n + 1, np.int32)
        row[1:] = np.maximum(0, np.maximum(diag, up))
        count = np.zeros(n + 1, np.int32)
        count[1:] = np.where(row[1:] == 0, 0, np.where(diag >= up, got[:-1] + same, got[1:]))
        # skipping words of b: a running maximum of row + position * gap
        lifted = row + steps
        top = np.maximum.accumulate(lifted)
        left = top - steps
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        moved = left > row
        count = np.where(moved, count[source], count)
        row = np.where(moved, left, row).astype(np.int32)
        run = np.concatenate([[0], np.where(same, run[:-1] + 1, 0)]).astype(np.int32)
        at = int(row.argmax())
        if row[at] > best:
            best, best_got = int(row[at]), int(count[at])
        best_run = max(best_run, int(run.max()))
        h, got = row, count
    return best, best_got, best_run


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, matched, run, item_words): every document and item that share a seed, aligned."""
    spark = docs.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/leaks-{uuid.uuid4().hex}"
    wanted = grams(items, item_id, text_col).select(F.col("id").alias("item"), F.col("pos").alias("at"), "gram")
    wanted.write.parquet(base + "/items")
    wanted = spark.read.parquet(base + "/items")
    keys = wanted.select("gram").distinct()
    keys = F.broadcast(keys) if wanted.count() <= BROADCAST_GRAMS else keys
    grams(docs, doc_id, text_col).join(keys, "gram").write.parquet(base + "/hits")
    hits = spark.read.parquet(base + "/hits")  # only grams that an item has
    often = hits.groupBy("gram").agg(F.approx_count_distinct("id", 0.02).alias("df"))
    # the rarest gram of every RUN words in a row
    reach = RUN - GRAM
    ranked = wanted.join(often, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    windows = ranked.withColumn("first", F.min(F.struct("df", "at", "gram")).over(W.partitionBy("item").orderBy("at").rowsBetween(0, reach))).withColumn("last", F.max("at").over(W.partitionBy("item")))
    seeds = windows.filter(F.col("at") + reach <= F.col("last")).select("item", "first.gram").distinct()
    hits.join(seeds, "gram").groupBy("id", "item").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).write.parquet(base + "/pairs")
    pairs = spark.read.parquet(base + "/pairs")
    # each text of the two sides once; the aligned part of a document is around its seeds
    with_item = pairs.join(items.select(F.col(item_id).cast("bigint").alias("item"), F.col(text_col).alias("item_text")).dropDuplicates(["item"]), "item")
    texts = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("id"), F.col(text_col).alias("doc_text"))
    # texts that share no seed with an item are left at the scan, before any text is shuffled
    few = pairs.select("id").distinct()
    texts = texts.join(F.broadcast(few) if few.count() <= BROADCAST_IDS else few, "id", "left_semi")
    both = with_item.join(texts, "id")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["item_text"] not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[row["item_text"]] = _hashes(words(row["item_text"]))
                a = known[row["item_text"]]
                b = _hashes(words(row["doc_text"]))[max(0, row["lo"] - len(a) - AROUND) : row["hi"] + len(a) + AROUND]
                out.append((row["id"], row["item"], *align(a, b), len(a)))
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "score", "matched", "run", "item_words"])

    return both.mapInArrow(score, "doc_id bigint, item_id bigint, score int, matched int, run int, item_words int")


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents with at least RUN consecutive words of the item."""
    # the alignment's score finds them, the run of equal words checks them: RUN words in a row score MATCH each
    return leaks(docs, items).filter(F.col("score") >= MATCH * RUN).filter(F.col("run") >= RUN).select("doc_id", "item_id").distinct()


def leaked_items(docs: DataFrame, items: DataFrame, least_score: int = 2 * RUN) -> DataFrame:
    """(item_id, documents, whole, best_score): per item the documents that hold it, and those with nine tenths of its words or more."""
    rows = leaks(docs, items).filter(F.col("score") >= least_score)
    return rows.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.count(F.when(F.col("matched") >= 0.9 * F.col("item_words"), 1)).alias("whole"), F.max("score").alias("best_score"))
