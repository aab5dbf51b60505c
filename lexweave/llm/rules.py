"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, words_of

# Frequent function words of four languages.
STOP_WORDS = {
    "de": "als am auch auf aus bei das dem den der des die ein eine einen er es für hat ich im in ist mit nicht "
    "sich sie sind so und von war wie wird zu zum".split(),
    "en": "a an and are as at be but by for from had has have he his in is it not of on or that the they this to "
    "was were which with you".split(),
    "es": "al como con de del el en es esta la las lo los más me no para pero por que se si su sus un una y".split(),
    "fr": "au aux avec ce ces dans de des du elle en est et il je la le les ne nous ou par pas plus pour qu que "
    "qui sa se sur un une vous".split(),
}

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``numerator`` must lie within percentages of ``denominator``, from ``least_words`` words on."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None
    least_words: int = 0


# Percentages, so that all comparisons are between whole numbers.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=200, high=1200),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("stop_words", "n_stop_words", "n_words", low=2, least_words=50),
    Rule("dup_lines", "n_dup_lines", "n_lines", high=50),
)
BASE = (Rule("repeats", "n_repeat_words", "n_words", high=20),)
LEAST_WORDS = 10


def holds(rule: Rule) -> Column:
    top, bottom = F.col(rule.numerator) * 100, F.col(rule.denominator)
    good = F.lit(True)
    if rule.low is not None:
        good = good & (top >= bottom * rule.low)
    if rule.high is not None:
        good = good & (top <= bottom * rule.high)
    return good | (F.col("n_words") < rule.least_words)


def _covered(places: Column) -> Column:
    """How many positions the windows starting at these ascending places cover."""
    steps = F.transform(
        places,
        lambda x, j: F.when(j + 1 < F.size(places), F.least(F.lit(WINDOW), F.get(places, j + 1) - x)).otherwise(WINDOW),
    )
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def measured(df: DataFrame, id_column: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts of each text: words, their characters, symbols, stop words, lines, repeats."""
    stops = sorted({w for group in STOP_WORDS.values() for w in group})
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(id_column), *keep,
        body.alias("_body"),
        words_of(F.col(text)).alias("_words"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    ).withColumn("n_words", F.size("_words").cast("long"))
    word = F.col("_words")
    starts = F.sequence(F.lit(0), F.size(word) - WINDOW)
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(word, i + k) for k in range(WINDOW)]))
    rows = rows.withColumn("_hashed", F.when(F.size(word) > WINDOW, hashed).otherwise(F.array().cast("array<bigint>")))
    # Equal windows have equal hashes, so texts without an equal pair of hashes are done;
    # the others compare the windows themselves.
    spelled = F.transform(
        starts, lambda i: F.struct(F.array_join(F.slice(word, i + 1, WINDOW), " ").alias("w"), i.alias("i"))
    )
    rows = rows.withColumn(
        "_sorted", F.when(F.size(F.array_distinct("_hashed")) < F.size("_hashed"), F.array_sort(spelled))
    )
    ordered = F.col("_sorted")

    def same(x, j):
        before = F.when(j > 0, F.get(ordered, j - 1)["w"] == x["w"]).otherwise(False)
        after = F.when(j + 1 < F.size(ordered), F.get(ordered, j + 1)["w"] == x["w"]).otherwise(False)
        return before | after

    rows = rows.withColumn("_places", F.array_sort(F.transform(F.filter(ordered, same), lambda x: x["i"])))
    lines = F.col("_lines")
    return rows.select(
        id_column, *keep, "n_words",
        (F.length("_body") - F.regexp_count("_body", F.lit(BLANK))).cast("long").alias("word_chars"),
        F.regexp_count("_body", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("_places")), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter(word, lambda w: F.lower(w).isin(stops))).cast("long").alias("n_stop_words"),
        F.size(lines).cast("long").alias("n_lines"),
    )


def judge(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES,
    least_words: int = LEAST_WORDS, keep: tuple[str, ...] = (),
) -> DataFrame:
    """The counts of each text, base_failed, kept, and the name of each rule that failed.

    Null and empty texts have no word, so they fail the base. Every row is judged by
    itself: copies and rows with a null id get the verdict of their text. Only the id, the
    text and ``keep`` are read, so names of other columns cannot clash.
    """
    counts = measured(df, id_column, text, keep)
    base_ok = F.lit(True)
    for rule in BASE:
        base_ok = base_ok & holds(rule)
    base_failed = (F.col("n_words") < least_words) | ~base_ok
    failed = F.filter(
        F.array(*[F.when(~holds(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull()
    ) if rules else F.array().cast("array<string>")
    passed = F.lit(True)
    for rule in rules:
        passed = passed & holds(rule)
    return counts.select(
        "*", base_failed.alias("base_failed"), (~base_failed & passed).alias("kept"), failed.alias("failed_rules")
    )


def judge_sql() -> str:
    """The same verdict over ``documents`` in DuckDB's SQL."""
    stops = ", ".join(f"'{w}'" for w in sorted({w for group in STOP_WORDS.values() for w in group}))

    def test(rule: Rule) -> str:
        parts = [f"100 * {rule.numerator} >= {rule.low} * {rule.denominator}"] if rule.low is not None else []
        parts += [f"100 * {rule.numerator} <= {rule.high} * {rule.denominator}"] if rule.high is not None else []
        return f"(n_words < {rule.least_words} OR ({' AND '.join(parts)}))"

    return f"""WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT r, i, words[i:i + 4] AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM split WHERE len(words) >= 5)),
repeated AS (SELECT r, w FROM windows GROUP BY r, w HAVING count(*) > 1),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words
  FROM windows JOIN repeated USING (r, w), (SELECT unnest(range(5)) AS k) GROUP BY r),
counts AS (
  SELECT doc_id, len(words) AS n_words,
         len(regexp_replace(body, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
         len(body) - len(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(words, lambda x: lower(x) IN ({stops}))) AS n_stop_words,
         len(lines) AS n_lines
  FROM split LEFT JOIN covered USING (r)),
judged AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(map(test, RULES))} AS kept
FROM judged"""
