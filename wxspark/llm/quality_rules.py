"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

``measured`` gives the counts of a text: words, characters in words, symbols, stop words, lines and repetition. A rule is a row of a
table: one count over another must lie between two percentages. ``compiled`` turns the table into columns, ``as_sql``
turns the same table into SQL text. Nothing is shuffled and no user function runs; a task holds one text and
its word array at a time.

Repeated windows are found inside the row: 64-bit hashes of all windows of three words are sorted with their places, and equal
neighbours mark the words they cover. Texts whose hashes all differ skip the sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, as the inside of a character class and as characters.
SPACE, SPACES = r"\x20\x09-\x0D", " \t\n\x0b\x0c\r"
#: Characters counted as symbols and as shouts.
SYMBOLS, SHOUTS = "#*$%&|<>", "!?"
#: Marks cut from both ends of a word before it is looked up among the stop words.
EDGES = ".,;:!?\"'()"
#: Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were which will with you",
    "de": "als an auf aus bei das dem den der des die ein eine einen einer er es für hat ich im in ist mit nicht sich sie sind und von war wie wird zu",
    "fr": "à au avec ce dans de des du elle en est et il je la le les ne nous par pas plus pour que qui sa se son sur un une",
    "es": "a al con de del el ella en es están fue ha la las lo los más no o para pero por que se son su sus un una y",
}
ALL_STOP_WORDS = tuple(sorted({w for words in STOP_WORDS.values() for w in words.split()}))


@dataclass(frozen=True)
class Rule:
    """100 x ``top`` must lie between ``least`` and ``most`` times ``over`` (a count, or None for 1); None leaves a side open."""

    name: str
    top: str
    over: str | None = None
    least: int | None = None
    most: int | None = None


#: Rules of the base verdict: enough words, and not over half of them in repeated windows.
BASE = (Rule("few_words", "n_words", None, least=5000), Rule("repeated_words", "n_repeat_words", "n_words", most=50))
#: Thresholds of the full verdict, in percent: word lengths of 2 to 12, symbols and shouts per word, share of stop words, lines.
RULES = (
    Rule("word_length", "word_chars", "n_words", least=200, most=1200),
    Rule("symbols", "n_symbols", "n_words", most=50),
    Rule("shouts", "n_shouts", "n_words", most=80),
    Rule("stop_words", "n_stop_words", "n_words", least=4),
    Rule("dup_lines", "n_dup_lines", "n_lines", most=50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", most=30),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_shouts", "n_stop_words", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines", "n_repeat_words")
WINDOW = 3


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words in windows that the word array holds twice or more, the first of them included."""

    def covered(sorted_pairs: Column) -> Column:
        last = F.size(sorted_pairs) - 1
        same = F.filter(
            F.sequence(F.lit(0), last),
            lambda j: ((j > 0) & (sorted_pairs[F.greatest(j - 1, F.lit(0))]["h"] == sorted_pairs[j]["h"]))
            | ((j < last) & (sorted_pairs[F.least(j + 1, last)]["h"] == sorted_pairs[j]["h"])),
        )
        places = F.sort_array(F.transform(same, lambda j: sorted_pairs[j]["i"]))
        return let(places, lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("at")),
                                                 lambda a, x: F.struct((a["n"] + F.least(F.lit(window), x - a["at"])).alias("n"), x.alias("at")))["n"])

    def repeats(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(pairs, covered))

    starts = F.sequence(F.lit(0), F.size(words) - window)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[words[i + k] for k in range(window)]))
    return F.when(F.size(words) <= window, 0).otherwise(let(hashes, repeats))


def measured(text: str | Column) -> Column:
    """All COUNTS of a text as one struct of longs; a null text has none of anything, like an empty one."""
    whole = F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))

    def without(t: Column, marks: str) -> Column:
        return F.length(t) - F.length(F.translate(t, marks, ""))

    def of_words(w: Column) -> Column:
        stops = F.filter(w, lambda x: F.lower(F.btrim(x, F.lit(EDGES))).isin(*ALL_STOP_WORDS))
        return F.struct(F.size(w).alias("n_words"), F.size(stops).alias("n_stop_words"), repeated_words(w).alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
            F.size(F.filter(x, lambda y: y.rlike(rf"^[{SPACE}]*[-*•]"))).alias("n_bullet_lines"),
            F.size(F.filter(x, lambda y: y.rlike(rf"(\.\.\.|…)[{SPACE}]*\z"))).alias("n_ellipsis_lines"),
        )

    def of_text(t: Column) -> Column:
        words = let(F.array_remove(F.split(t, f"[{SPACE}]+"), ""), of_words)
        lines = let(F.filter(F.split(t, "\n"), lambda y: y.rlike(f"[^{SPACE}]")), of_lines)
        sums = F.struct(F.length(F.translate(t, SPACES, "")).alias("word_chars"), without(t, SYMBOLS).alias("n_symbols"), without(t, SHOUTS).alias("n_shouts"))
        return F.struct(words.alias("words"), lines.alias("lines"), sums.alias("sums"))

    of = {"words": ("n_words", "n_stop_words", "n_repeat_words"), "sums": ("word_chars", "n_symbols", "n_shouts"), "lines": ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines")}
    group = {name: g for g, names in of.items() for name in names}
    return let(let(whole, of_text), lambda m: F.struct(*[m[group[c]][c].cast("long").alias(c) for c in COUNTS]))


def broken(rule: Rule, counts: Column) -> Column:
    """True where the counts break a rule; a text without any of ``over`` breaks no ratio."""
    top, over = counts[rule.top] * 100, F.lit(1).cast("long") if rule.over is None else counts[rule.over]
    out = F.lit(False)
    if rule.least is not None:
        out = out | (top < over * rule.least)
    if rule.most is not None:
        out = out | (top > over * rule.most)
    return out


def compiled(rules: tuple[Rule, ...], counts: Column) -> Column:
    """Names of all broken rules as an array, in the order of the table."""
    return F.filter(F.array(*[F.when(broken(r, counts), r.name) for r in rules]), lambda x: x.isNotNull())


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, into: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``into``: all counts, broken rules, base_failed and kept. One projection, no shuffle.

    Null texts count as empty and fail the base rules; all other columns stay, whatever their names, but a column
    called ``into`` is replaced. Repeated rows are judged each. An empty table stays empty.
    """

    def verdict(c: Column) -> Column:
        bad, more = F.size(compiled(base, c)) > 0, compiled((*base, *rules), c)
        return F.struct(*[c[n].alias(n) for n in COUNTS], bad.alias("base_failed"), (F.size(more) == 0).alias("kept"), F.concat_ws(",", more).alias("broken"))

    # Counted in a column of its own, so that the reader of one field does not count again.
    return docs.withColumn(into, let(measured(f"`{text}`"), verdict))


def report(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, counts, base_failed, kept, broken) of every document."""
    return judged(docs.select(doc_id, "text")).select(doc_id, "quality.*")


def as_sql(rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> str:
    """The same counts and the same table as SQL over a table ``documents``."""

    def fails(r: Rule) -> str:
        over = "1" if r.over is None else r.over
        sides = [f"100 * {r.top} < {r.least} * {over}"] * (r.least is not None) + [f"100 * {r.top} > {r.most} * {over}"] * (r.most is not None)
        return "(" + " OR ".join(sides) + ")"

    def names(table: tuple[Rule, ...]) -> str:
        return "concat_ws(',', " + ", ".join(f"CASE WHEN {fails(r)} THEN '{r.name}' END" for r in table) + ")"

    stops = ", ".join(f"'{w}'" for w in ALL_STOP_WORDS)
    edges = EDGES.replace("'", "''")
    spaces = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^{SPACE}]+') AS w, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^{SPACE}]')) AS x FROM d),
g AS (SELECT r, i, w[i:i + {WINDOW - 1}] AS g FROM a, LATERAL (SELECT unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i) s),
n AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM n, (SELECT unnest(generate_series(0, {WINDOW - 1})) AS k) GROUP BY r),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(t) - length(regexp_replace(t, '[^{SPACE}]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(length(t) - length(translate(t, '{SHOUTS}', '')) AS BIGINT) AS n_shouts,
             CAST(len(list_filter(w, lambda y: lower(trim(y, '{edges}')) IN ({stops}))) AS BIGINT) AS n_stop_words,
             CAST(len(x) AS BIGINT) AS n_lines, CAST(len(x) - len(list_distinct(x)) AS BIGINT) AS n_dup_lines,
             CAST(len(list_filter(x, lambda y: regexp_matches(y, '^[{SPACE}]*[-*•]'))) AS BIGINT) AS n_bullet_lines,
             CAST(len(list_filter(x, lambda y: regexp_matches(y, '(\\.\\.\\.|…)[{SPACE}]*\\z'))) AS BIGINT) AS n_ellipsis_lines,
             CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words FROM a LEFT JOIN p USING (r))
SELECT doc_id, {", ".join(COUNTS)}, {names(base)} <> '' AS base_failed, {names((*base, *rules))} = '' AS kept, {names((*base, *rules))} AS broken FROM c"""
