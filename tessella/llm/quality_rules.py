"""Line-first quality rules, in DataFrame functions only.

Each different line of a text is judged by itself. It fails by

* punctuation: symbols and exclamation marks are over a tenth of its characters;
* shouting: capitals are over half of its characters;
* navigation: two or more bars, and one for every four words;
* boilerplate: at most 40 words, with a stock phrase of web pages.

Failing lines and later copies of a line go. A document is rejected if less than half
of its characters is left, or if it fails the base rules on its whole text: under 20
words, or over 30 % of its words in 8-word windows that the text holds twice.

Edge cases: null and empty texts have no words and fail the base rule; blank lines
count for nothing; rows are judged one by one, so repeated rows and null ids change
nothing; an empty table gives an empty result; columns of docs that carry one of the
new names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, named_back, read, renamed

#: Character classes, of one syntax in Spark and in SQL engines with RE2.
SYMBOLS = "#*$%&|<>"
MARKS = SYMBOLS + "!"
CAPITALS = "A-ZÀ-ÖØ-Þ"
BARS = "|"
#: Stock phrases of web pages, in lower case.
STOCK = [
    "accept cookies", "add to cart", "back to top", "click here", "cookie policy", "javascript is", "log in",
    "powered by", "privacy policy", "read more", "sign up", "skip to content", "subscribe to", "terms of use",
]
WIDTH = 8
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def _count(col: Column, chars: str) -> Column:
    """How many characters are of a class: what is left when runs of others go."""
    return F.length(F.regexp_replace(col, f"[^{chars}]+", ""))


def _without(col: Column, chars: str) -> Column:
    for c in chars:
        col = F.replace(col, F.lit(c), F.lit(""))
    return col


def _solid(col: Column) -> Column:
    """The number of characters but the ASCII blanks."""
    return F.length(_without(col, " \n\t\r\x0b\f"))


def line_fails(line: Column) -> Column:
    size = _solid(line)
    words = F.length(line) - F.length(_without(line, " ")) + 1
    bars = F.length(line) - F.length(_without(line, BARS))
    stock = F.lit(False)
    low = F.lower(line)
    for phrase in STOCK:
        stock = stock | low.contains(phrase)
    return (
        (10 * _count(line, MARKS) > size)
        | (2 * _count(line, CAPITALS) > size)
        | ((bars >= 2) & (4 * bars >= words))
        | ((words <= 40) & stock)
    )


def measure(docs: DataFrame) -> DataFrame:
    """docs with the columns ``COLUMNS`` and _lines, the lines that stay."""
    docs = docs.drop(*COLUMNS, "_lines")
    named, new = renamed(docs, ("text",))
    d = _measure(named)
    return d.select(*named_back(d, new, docs.columns), *COLUMNS, "_lines")


def _measure(docs: DataFrame) -> DataFrame:
    """``measure`` of a column text and others that clash with no name in here."""
    own = [F.col(c) for c in docs.columns]
    d = docs.select(*own, F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    words = F.filter(F.split("_t", BLANKS), lambda w: w != "")
    lines = F.filter(F.split("_t", "\n"), lambda x: _solid(x) > 0)
    d = d.select(*own, "_t", words.alias("_w"), lines.alias("_all"))
    d = d.select(
        *own, "_w", F.size("_w").cast("long").alias("n_words"), _solid(F.col("_t")).cast("long").alias("word_chars"),
        _count(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
        F.size("_all").alias("_n"), F.array_distinct("_all").alias("_once"),
        F.when(
            F.size("_w") >= WIDTH,
            F.transform(F.sequence(F.lit(1), F.size("_w") - (WIDTH - 1)), lambda i: F.xxhash64(F.slice("_w", i, WIDTH))),
        ).alias("_h"),
    ).drop("_w")
    # most texts repeat no window; only the others sort theirs
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    d = d.select(
        *own, "n_words", "word_chars", "n_symbols", "_once",
        (F.col("_n") - F.size("_once")).cast("long").alias("n_dup_lines"),
        F.when(twice, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"),
        F.filter("_once", lambda x: ~line_fails(x)).alias("_lines"),
    )
    repeated = F.filter(
        F.transform(
            "_s",
            lambda x, k: F.when(
                (F.get("_s", k - 1)["h"] == x["h"]) | (F.get("_s", k + 1)["h"] == x["h"]), x["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    d = d.withColumn("_p", F.sort_array(repeated)).drop("_s")
    steps = F.transform("_p", lambda p, k: F.least(F.lit(WIDTH), F.coalesce(F.get("_p", k + 1) - p, F.lit(WIDTH))))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    left = F.aggregate(F.transform("_lines", _solid), F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.select(
        *own, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).alias("n_repeat_words"),
        left.alias("_left"), "_lines",
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    d = d.withColumn("base_failed", failed)
    return d.withColumn("kept", ~F.col("base_failed") & (2 * F.col("_left") >= F.col("word_chars"))).select(
        *own, *COLUMNS, "_lines"
    )


def clean(docs: DataFrame) -> DataFrame:
    """The documents that stay, with the columns of docs: text without its failing lines,
    and n_chars, if docs has it, the new length. Texts that lose no line stay as they are."""
    names = docs.columns
    own, new = renamed(docs, ("text",))
    at = dict(zip(names, new, strict=True))
    d = _measure(own)
    d = d.select("text", "kept", *(at[c] for c in names if c != "text"), F.array_join("_lines", "\n").alias("_new"))
    text = F.when(_solid(F.col("_new")) < _solid(F.col("text")), F.col("_new")).otherwise(F.col("text"))
    own = [text.alias("text") if c == "text" else F.col(at[c]).alias(c) for c in names]
    # an exploded array, as a filter would be pushed below and copy every expression
    d = d.select(F.explode(F.when(F.col("kept"), F.array(F.struct(*own)))).alias("d")).select("d.*")
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        d = d.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(kind))
    return d


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return measure(docs).select("doc_id", *COLUMNS)


def _sql_count(col: str, chars: str) -> str:
    return f"length(regexp_replace({col}, '[^{chars}]+', '', 'g'))"


_SQL_SOLID = "length(regexp_replace({}, '[\\x20\\x09-\\x0D]+', '', 'g'))"
_SQL_STOCK = " or ".join(f"contains(lower(x), '{p}')" for p in STOCK)

#: CTEs over a relation ``docs_in`` (doc_id, text): the relation ``measured``.
MEASURE_SQL = f"""
base as (select doc_id, coalesce(text, '') as t from docs_in),
words as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from base),
grams as (
  select doc_id, i, array_to_string(w[i:i+{WIDTH - 1}], ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) as i from words where len(w) >= {WIDTH})),
often as (select doc_id, g from grams group by doc_id, g having count(*) > 1),
marks as (
  select doc_id, least({WIDTH}, coalesce(lead(i) over (partition by doc_id order by i) - i, {WIDTH})) as k
  from grams semi join often using (doc_id, g)),
repeats as (select doc_id, cast(sum(k) as bigint) as n from marks group by doc_id),
parts as (
  select doc_id, x, min(k) as k, count(*) as n
  from (select doc_id, unnest(string_split(t, chr(10))) as x, unnest(range(len(string_split(t, chr(10))))) as k from base)
  where {_SQL_SOLID.format("x")} > 0 group by doc_id, x),
judged as (
  select doc_id, n, k, x, {_SQL_SOLID.format("x")} as size,
    10 * {_sql_count("x", MARKS)} > {_SQL_SOLID.format("x")}
    or 2 * {_sql_count("x", CAPITALS)} > {_SQL_SOLID.format("x")}
    or ({_sql_count("x", BARS)} >= 2 and 4 * {_sql_count("x", BARS)} >= {_sql_count('x', ' ')} + 1)
    or ({_sql_count('x', ' ')} + 1 <= 40 and ({_SQL_STOCK})) as bad
  from parts),
lines as (
  select doc_id, cast(sum(n) - count(*) as bigint) as dups, cast(sum(case when bad then 0 else size end) as bigint) as size,
    string_agg(x, chr(10) order by k) filter (where not bad) as left_text
  from judged group by doc_id),
measured as (
  select *, not base_failed and 2 * left_chars >= word_chars as kept from (
    select doc_id, cast(len(w) as bigint) as n_words, cast({_SQL_SOLID.format("t")} as bigint) as word_chars,
      cast({_sql_count("t", SYMBOLS)} as bigint) as n_symbols, coalesce(lines.dups, 0) as n_dup_lines,
      coalesce(repeats.n, 0) as n_repeat_words,
      len(w) < 20 or 100 * coalesce(repeats.n, 0) > 30 * len(w) as base_failed,
      coalesce(lines.size, 0) as left_chars, coalesce(lines.left_text, '') as left_text, t
    from words left join repeats using (doc_id) left join lines using (doc_id)))
"""

SQL = f"""
with docs_in as (select doc_id, text from documents), {MEASURE_SQL}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from measured
"""
