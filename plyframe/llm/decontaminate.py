"""Benchmark decontamination as a prefix-filtered set join.

An item is cut into windows of ten words, a window into word shingles of five (a shorter
one is a shingle by itself). A window occurs in a document only if all its shingles do,
so one of them, the necessary prefix, is enough to look it up: shingles are ordered by
their count over all documents and the rarest is taken; a window with a shingle that no
document has is dropped. Documents give out the places of prefix shingles with the words
around them; the join on the shingle applies the positional bound (the window must start
inside the document) and the length bound (it must end there), then compares the words.

Two scans of the texts and no shuffle of them. The scans test shingles against a bitmap of
fixed size; what passes by chance is dropped by the join, so any number of items is whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.llm.common import LOWER, ByteWords, cut, few, mix64, table, texts_together

WINDOW = 10
SHINGLE = 5
#: bits of the bitmap over shingle hashes: 2 MB whatever the benchmark's size
FILTER_BITS = 24
#: bytes of text worked on at a time
CHUNK = 1 << 21
IS_WORD = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` word hashes."""
    out = np.zeros(max(0, len(h) - width + 1), dtype=np.uint64)
    for k in range(width):
        out += mix64(h[k : k + len(out)] + np.uint64(k)) * np.uint64(2 * k + 3)
    return mix64(out ^ np.uint64(width)).view(np.int64)


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > CHUNK:
            yield lo, i
            lo, total = i, 0
        total += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def _pieces(text: bytes) -> Iterator[tuple[bytes, ByteWords, int, int, int]]:
    """A long text in stretches of about ``CHUNK`` bytes, cut between words: bytes, words, the
    number of the first word in the text, and the words of the stretch that are its own. Around
    each of those there are WINDOW - 1 words on either side, where the text has them."""
    lo = number = own = 0
    while True:
        hi = lo + CHUNK
        while hi < len(text) and IS_WORD[LOWER[text[hi]]]:
            hi += 1
        data = text[lo:hi].translate(LOWER)
        words = ByteWords(data, IS_WORD)
        n = len(words.start)
        last = hi >= len(text)
        if not last and n < 4 * WINDOW:  # hardly a word in so many bytes: read on
            hi = len(text)
            data = text[lo:].translate(LOWER)
            words, last = ByteWords(data, IS_WORD), True
            n = len(words.start)
        upto = n if last else n - (WINDOW - 1)
        yield data, words, number, own, upto
        if last:
            return
        back = n - 2 * (WINDOW - 1)
        lo, number, own = lo + int(words.start[back]), number + back, WINDOW - 1


def _encoded(texts) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]


def _passing(words: ByteWords, widths: list[int], bitmap: np.ndarray):
    """(width, word, hash) of the shingles that pass the bitmap."""
    for w in widths:
        h = shingle_hashes(words.hash, w)
        slot = h & ((1 << FILTER_BITS) - 1)
        ok = np.flatnonzero((bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
        yield w, ok, h[ok]


def _scan(texts: list[bytes], widths: list[int], bitmap: np.ndarray):
    """Of some texts at a time: the first of them, their bytes and words, the text of each word
    counted from the first, the number in the text of each text's first word here, how many
    words of each are counted here, and the (width, word, hash) of shingles that pass the
    bitmap, each once."""
    for lo, hi in _chunks(texts):
        if hi - lo == 1 and len(texts[lo]) > 2 * CHUNK:
            for data, words, number, own, upto in _pieces(texts[lo]):
                found = []
                for w, at, h in _passing(words, widths, bitmap):
                    keep = (at >= own) & (at < upto)
                    found.append((w, at[keep], h[keep]))
                yield lo, data, words, np.zeros(len(words.start), dtype=np.int64), [number], [upto - own], found
            continue
        data = b"\0".join(t.translate(LOWER) for t in texts[lo:hi])
        words = ByteWords(data, IS_WORD)
        edge = np.cumsum([0] + [len(t) + 1 for t in texts[lo:hi]])
        row = np.searchsorted(edge, words.start, side="right") - 1
        found = []
        for w, at, h in _passing(words, widths, bitmap):
            same = row[at] == row[at + w - 1]
            found.append((w, at[same], h[same]))
        yield lo, data, words, row, [0] * (hi - lo), np.bincount(row, minlength=hi - lo).tolist(), found


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, words, tokens): every window of every item, tokens[p] the hash of the
    shingle at its word p, and width the shingles' length. Null texts have no words."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = []
            for item, text in zip(d["item_id"], _encoded(d["text"])):
                at = ByteWords(text, IS_WORD)
                words = [text[a:b].decode("utf-8", "surrogatepass") for a, b in zip(at.start, at.end)]
                if not words:
                    continue
                size = min(WINDOW, len(words))
                width = min(SHINGLE, len(words))
                h = shingle_hashes(at.hash, width)
                out += [(item, words[i : i + size], width, h[i : i + size - width + 1].tolist()) for i in range(len(words) - size + 1)]
            yield pd.DataFrame(out, columns=["item_id", "words", "width", "tokens"])

    return (
        items.select(F.col("item_id").cast("long"), F.col("text"))
        .where("item_id is not null")
        .mapInPandas(cut_up, "item_id long, words array<string>, width int, tokens array<long>")
    )


def _bitmap(tokens: DataFrame) -> np.ndarray:
    slots = tokens.select(F.expr(f"(token & {(1 << FILTER_BITS) - 1}) + 1").alias("s"))  # bitmap functions count from 1
    parts = slots.groupBy(F.expr("bitmap_bucket_number(s)").alias("n")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 8 + 4096, dtype=np.uint8)
    for n, bits in parts.collect():  # at most 2^24 / 32768 + 1 rows of 4 KB
        lo = (n - 1) * 4096
        out[lo : lo + 4096] = np.frombuffer(bits, dtype=np.uint8)
    return out


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, text_hash, n_words, n_hit, n_items,
    items_sha256, contaminated. Items without an id are ignored. A null or wordless text
    has no hits; a repeated row gets the same result each time; rows that share an id but
    not the text count apart. A very long text is read in stretches, so it takes some forty
    times ``CHUNK`` bytes besides its own; of shingles that are equally rare the smallest
    hash is taken. Empty tables give no rows, or rows without hits. Extra columns are left
    out, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_hash"))
    windows = cut(item_windows(items))
    tokens = cut(windows.select("width", F.explode("tokens").alias("token")).distinct())
    widths = sorted(r[0] for r in tokens.select("width").distinct().collect())  # 1 to 5
    bits = spark.sparkContext.broadcast(_bitmap(tokens))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for *_, found in _scan([t or b"" for t in d["text"]], widths, bits.value):
                for *_, h in found:
                    token, n = np.unique(h, return_counts=True)
                    yield pd.DataFrame({"token": token, "n": n})

    rarity = docs.select("text").mapInPandas(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).join(tokens.select("token").distinct(), "token", "left_semi")
    each = windows.select("item_id", "words", "width", F.posexplode("tokens").alias("p", "token")).join(rarity, "token", "left")
    prefix = (
        each.groupBy("item_id", "words", "width")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "p")).alias("rarest"))
        .where("rarest.n > 0")
        .select("item_id", "words", F.size("words").alias("size"), "width", F.col("rarest.token").alias("token"), F.col("rarest.p").alias("p"))
    )
    with texts_together(spark):
        prefix = cut(prefix)
    chosen = spark.sparkContext.broadcast(_bitmap(prefix.select("token")))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            texts = [t or b"" for t in d["text"]]
            n_words = [0] * len(texts)
            hits: list[list] = [[] for _ in texts]
            for lo, data, words, row, number, counted, found in _scan(texts, widths, chosen.value):
                total = np.bincount(row, minlength=len(number))
                first = np.cumsum(total) - total
                for k, n in enumerate(counted):
                    n_words[lo + k] += n
                for _, at, h in found:
                    for i, token in zip(at.tolist(), h.tolist()):
                        r = row[i]
                        a = max(first[r], i - (WINDOW - 1))
                        b = min(first[r] + total[r], i + WINDOW)
                        around = [data[x:y].decode("utf-8", "surrogatepass") for x, y in zip(words.start[a:b], words.end[a:b])]
                        hits[lo + r].append({"token": token, "q": int(i - first[r]) + number[r], "before": int(i - a), "around": around})
            yield pd.DataFrame({"doc_id": d["doc_id"].astype("Int64"), "text_hash": d["text_hash"], "n_words": n_words, "hits": hits})

    with texts_together(spark):
        marked = cut(docs.mapInPandas(places, "doc_id long, text_hash long, n_words long, hits array<struct<token:long,q:int,before:int,around:array<string>>>"))
    hits = marked.select("doc_id", "text_hash", "n_words", F.explode("hits").alias("h")).select("doc_id", "text_hash", "n_words", "h.*")
    same = (
        hits.join(prefix, "token")
        .where("q >= p and q - p + size <= n_words")
        .where("slice(around, before - p + 1, size) = words")
        .select("doc_id", "text_hash", "item_id", (F.col("q") - F.col("p")).alias("at"), "size")
        .distinct()
    )
    same = cut(same)
    of = ["doc_id", "text_hash"]
    spans = same.select(*of, "at", "size").distinct().select(*of, F.explode(F.expr("sequence(at, at + size - 1)")).alias("word")).distinct()
    n_hit = spans.groupBy(*of).agg(F.count("*").alias("n_hit"))
    of_items = same.select(*of, F.col("item_id").cast("string").alias("item")).distinct().groupBy(*of).agg(
        F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("item"))), 256).alias("items_sha256")
    )
    both = n_hit.join(of_items, of).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "n_hit", "n_items", "items_sha256")
    return marked.join(both, (marked.doc_id.eqNullSafe(both.d)) & (marked.text_hash == both.t), "left").select(
        "doc_id",
        "text_hash",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the contaminated rows; columns unchanged. A row counts by its id and its
    text, so repeated rows go or stay together; null, empty and long texts, items without an
    id and empty tables as in decontaminate."""
    bad = cut(decontaminate(docs, items).where("contaminated").select(F.col("doc_id").alias("__ply_d"), F.col("text_hash").alias("__ply_t")).distinct())
    return docs.join(few(bad), F.col("doc_id").cast("long").eqNullSafe(F.col("__ply_d")) & (F.xxhash64("text") == F.col("__ply_t")), "left_anti")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = rf"""
with dw as (select doc_id, {_WORDS} as w from documents),
iw as (select item_id, {_WORDS} as w from benchmark),
win as (
  select distinct item_id, least(10, len(w)) as size, list_slice(w, i, i + least(10, len(w)) - 1) as words
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from iw where len(w) > 0)),
sizes as (select distinct size from win),
places as (
  select doc_id, size, i, list_slice(w, i, i + size - 1) as words
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from dw, sizes where len(w) >= size)),
hit as (select p.doc_id, w.item_id, p.i, p.size from places p join win w on p.words = w.words and p.size = w.size),
words_hit as (
  select doc_id, count(distinct pos) as n_hit
  from (select doc_id, unnest(range(i, i + size)) as pos from (select distinct doc_id, i, size from hit)) group by doc_id),
items_hit as (
  select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
  from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw d left join words_hit h on d.doc_id = h.doc_id left join items_hit i on d.doc_id = i.doc_id
"""
