"""Line deduplication by winnowing over line hashes, in DataFrame operations only.

A document is its lines that hold a word, which is what stands between white space; a run of lines is hashed where it is the shortest from
its first line with at least ``RUN_WORDS`` words. For every window, the shortest stretch
of lines with at least ``PASSAGE_WORDS`` words, the smallest run hash inside is selected.
Two documents that share a passage of that many words in whole lines share a window, and
so select the same run: no such passage is missed, and few runs are selected.

Around each selected run that occurs more than once, every window that selected it is held
against the first occurrence of that window (smallest doc_id, then position), and is deleted
unless it is that one. Windows are taken forwards from each line and backwards from each line,
so every line of a repeated stretch of ``PASSAGE_WORDS`` words or more is in a repeated window:
all of its lines go, whichever documents hold its parts. Every deleted line has an equal line
earlier, so one copy always stays.

Each occurrence meets one other, so the work follows the number of copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyframe.llm.common import cut, few, stored, table

RUN_WORDS = 25
PASSAGE_WORDS = 50
KEY = ["doc_id", "text_hash"]


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _reach(words: int) -> str:
    """Number of lines from line i on until there are so many words; 0 if they run out."""
    fold = f"aggregate(slice(w, i + 1, {words}), named_struct('s', 0, 'k', 0), (a, x) -> if(a.s >= {words}, a, named_struct('s', a.s + x, 'k', a.k + 1)), a -> if(a.s >= {words}, a.k, 0))"
    return f"transform(w, (n, i) -> if(n >= {words}, 1, {fold}))"


#: words of a line x: the longest parts without white space
_WORDS = r"regexp_count(x, '[^ \t\r\u000B\u000C]+')"
_LINES = f"filter(transform(split(text, '\\n'), (x, i) -> named_struct('at', i, 'h', xxhash64(x), 'n', {_WORDS})), s -> s.n > 0)"
#: the run with the smallest hash among those inside the lines x.i to x.e
_PICK = (
    "array_min(transform(sequence(x.i, x.e), j -> "
    "if(r[j] > 0 and j + r[j] <= x.e + 1, named_struct('hash', xxhash64(slice(h, j + 1, r[j])), 'back', -j), null)))"
)
#: windows from each line on, and up to each line those that are not among them
_WINDOWS = (
    "concat(filter(transform(f, (q, i) -> named_struct('i', i, 'e', i + q - 1)), x -> x.e >= x.i), "
    "filter(transform(b, (q, k) -> named_struct('i', size(b) - k - q, 'e', size(b) - 1 - k)), x -> x.e >= x.i and x.i + f[x.i] - 1 <> x.e))"
)
_SELECT = _let(
    "u.n",
    "w",
    _let(
        "u.h",
        "h",
        _let(
            _reach(RUN_WORDS),
            "r",
            _let(
                _reach(PASSAGE_WORDS),
                "f",
                _let(_let("reverse(w)", "w", _reach(PASSAGE_WORDS)), "b", f"transform({_WINDOWS}, x -> named_struct('i', x.i, 'e', x.e, 'pick', {_PICK}))"),
            ),
        ),
    ),
)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, at, h, wins): positions and hashes of the non-empty lines, and the
    windows by first and last line with the selected (hash, -line). One row per distinct
    (doc_id, text); no shuffle of texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text"))
    marked = rows.where("text is not null").withColumn("u", F.expr(_LINES))
    # explode keeps the optimizer from computing u again at each use
    marked = marked.select(*KEY, F.explode(F.array("u")).alias("u"))
    return marked.select(*KEY, F.expr("u.at").alias("at"), F.expr("u.h").alias("h"), F.expr(_SELECT).alias("wins"))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, ranges, sources): the ranges of lines to delete in a text, and
    the ids of the documents that hold them earlier."""
    marked = stored(fingerprints(docs).dropDuplicates(KEY))
    picked = marked.select(*KEY, F.explode("wins").alias("x")).groupBy(*KEY, F.col("x.pick.hash").alias("run")).agg(F.min("x.pick.back").alias("lo"), F.max("x.pick.back").alias("hi"))
    # more than one place, in one document or in several; written, so that the join can
    # split a run that very many documents share
    shared = cut(picked.groupBy("run").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("n > 1 or lo <> hi").select("run"))
    runs = picked.select(*KEY, "run").join(shared, "run").groupBy(*KEY).agg(F.collect_set("run").alias("runs"))
    runs = runs.select(F.col("doc_id").alias("d1"), F.col("text_hash").alias("t1"), "runs")
    both = marked.join(runs, F.col("doc_id").eqNullSafe(F.col("d1")) & (F.col("text_hash") == F.col("t1")))
    window = F.expr("filter(wins, x -> array_contains(runs, x.pick.hash))")
    occur = both.select(*KEY, "at", "h", F.explode(window).alias("x")).select(
        *KEY,
        F.expr("x.i").alias("i"),
        F.expr("x.e").alias("e"),
        F.expr("at[x.i]").alias("lo"),
        F.expr("at[x.e]").alias("hi"),
        F.expr("xxhash64(slice(h, x.i + 1, x.e - x.i + 1))").alias("hash"),
        F.expr("hash(slice(h, x.i + 1, x.e - x.i + 1))").alias("more"),
    )
    occur = stored(occur)
    first = cut(
        occur.groupBy("hash", "more")
        .agg(F.min(F.struct("doc_id", "text_hash", "i")).alias("f"), F.count("*").alias("n"))
        .where("n > 1")
        .select("hash", "more", F.col("f.doc_id").alias("d0"), F.col("f.text_hash").alias("t0"), F.col("f.i").alias("i0"))
    )
    later = occur.join(first, ["hash", "more"]).where("not (doc_id <=> d0 and text_hash = t0 and i = i0)")
    # a document that has the window before is its own source
    again = F.lag(F.struct("hash", "more")).over(Window.partitionBy(*KEY).orderBy("hash", "more", "i")).eqNullSafe(F.struct("hash", "more"))
    later = later.withColumn("source", F.when(again, F.col("doc_id")).otherwise(F.col("d0")))
    # windows that touch are one stretch, so empty lines inside it go too
    order = Window.partitionBy(*KEY).orderBy("i", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("new", F.coalesce((F.col("i") > reach + 1).cast("int"), F.lit(1)))
    later = later.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = later.groupBy(*KEY, "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_set("source").alias("s"))
    return parts.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("s")))).alias("sources"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with the later repeated runs taken out of ``text``, and n_lines (lines before),
    n_removed, sources.

    Null text stays null with no lines; an empty one has one empty line. Rows equal in id
    and text are one document and change alike; an id that comes with several texts orders
    them by a hash. A null id comes first. Lines without a word between deleted ones go with
    them. A line is compared as it is, white space included. A very long text is one row, and
    its lines are hashed in place; windows reach no further than ``PASSAGE_WORDS`` words. An
    empty table gives an empty table. Columns named n_lines, n_removed or sources are
    replaced, others kept.
    """
    found = stored(repeats(docs)).select(F.col("doc_id").alias("__ply_d"), F.col("text_hash").alias("__ply_t"), F.col("ranges").alias("__ply_r"), F.col("sources").alias("__ply_s"))
    plain = docs.drop("n_lines", "n_removed", "sources").withColumn("__ply_h", F.xxhash64("text"))
    found = few(found, "1 + size(__ply_r) + size(__ply_s)")
    both = plain.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("__ply_d")) & (F.col("__ply_h") == F.col("__ply_t")), "left")
    kept = F.expr("filter(split(text, '\\n'), (x, i) -> not exists(__ply_r, r -> i between r.lo and r.hi))")
    both = both.withColumn("__ply_k", F.when(F.col("__ply_r").isNotNull(), kept))
    n = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    names = [c for c in plain.columns if c != "__ply_h"]
    return both.select(
        *[F.when(F.col("__ply_k").isNotNull(), F.array_join("__ply_k", "\n")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in names],
        n.cast("long").alias("n_lines"),
        F.when(F.col("__ply_k").isNotNull(), n - F.size("__ply_k")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("__ply_s", F.array().cast("array<bigint>")).alias("sources"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated runs deleted, without the rows of which nothing is left; n_chars
    follows the text. Columns unchanged. Null, empty, long and repeated texts, ties and empty
    tables as in deduplicate; texts that lose nothing stay, null and empty ones too."""
    done = deduplicate(docs).where(r"text is null or n_removed = 0 or text rlike '[^ \t\r\n\u000B\u000C]'")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(docs.columns)


_BLANK = r"[^ \t\r\x0B\x0C]+"
OP6_SQL = rf"""
with d as (select distinct doc_id, text, string_split(text, chr(10)) as lines from documents where text is not null),
l as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from d),
w as (
  select doc_id, pos, line, row_number() over o as i, sum(n) over o as upto, sum(n) over o - n as below
  from (select *, len(regexp_extract_all(line, '{_BLANK}')) as n from l) where n > 0 window o as (partition by doc_id order by pos)),
texts as (select doc_id, list(line order by i) as lines, list(upto order by i) as upto, list(below order by i) as below from w group by doc_id),
wins as (
  select w.doc_id, w.i as i, 1 + len(list_filter(t.upto, lambda u: u < w.below + {PASSAGE_WORDS})) as e from w join texts t using (doc_id)
  union
  select w.doc_id, len(list_filter(t.below, lambda u: u <= w.upto - {PASSAGE_WORDS})), w.i from w join texts t using (doc_id)),
named as (
  select doc_id, i, e, array_to_string(lines[i:e], chr(10)) as content from wins join texts using (doc_id) where i > 0 and e <= len(lines)),
placed as (select *, first_value(doc_id) over o as d0, row_number() over o as k, row_number() over (partition by content, doc_id order by i) as own from named window o as (partition by content order by doc_id, i)),
later as (select *, case when own - (d0 = doc_id)::int > 1 then doc_id else d0 end as source from placed where k > 1),
gone as (select distinct doc_id, unnest(range(i, e + 1)) as i from later),
marked as (
  select l.doc_id, l.pos, l.line,
         coalesce(last_value(g.i ignore nulls) over up = last_value(w.i ignore nulls) over up and first_value(g.i ignore nulls) over down = first_value(w.i ignore nulls) over down, false) as out
  from l left join w using (doc_id, pos) left join gone g on g.doc_id = w.doc_id and g.i = w.i
  window up as (partition by l.doc_id order by l.pos rows between unbounded preceding and current row),
         down as (partition by l.doc_id order by l.pos rows between current row and unbounded following)),
kept as (select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (not out), '') as text, count(*) filter (out) as n_removed from marked group by doc_id),
seen as (select doc_id, list_sort(list(distinct source)) as sources from later group by doc_id)
select d.doc_id, case when d.text is null then null else k.text end as text,
       coalesce(len(d.text) - len(replace(d.text, chr(10), '')) + 1, 0) as n_lines, coalesce(k.n_removed, 0) as n_removed,
       coalesce(s.sources, []) as sources
from documents d left join kept k using (doc_id) left join seen s using (doc_id)
"""
