"""Quality rules per document and per host, in DataFrame functions throughout.

Rules of a document look at its words (between ASCII white space), symbols, repeated
lines and repeated word triples. All of that is worked out inside the row: triples
are compared by 64-bit hashes of their words, sorted together with their places, so
no word leaves its row. Host-level rules: the failures are counted by host, the rates
of all hosts give an empirical beta prior (by their mean and variance), and every
rate is shrunk towards it, so that a host of few documents is not judged by them
alone. A host whose shrunk rate is over the limit fails; its verdict is joined back,
and there a document also needs to pass the soft rules. Elsewhere only the base rules
reject.

Results: a null text has no words, which fails the base rules. Rows without a host
form one host. Repeated rows are judged and counted one by one. An empty table gives
an empty result. Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import SPACED_WORD, staged, text_of
from orderflow.operators.columns import settle

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"

LEAST_WORDS, MOST_REPEATED = 50, 50

#: Soft rules, in hundredths of the words or lines.
MOST_SYMBOLS, MOST_DUP_LINES, SHORTEST_MEAN, LONGEST_MEAN = 10, 30, 2, 15

#: A host fails if its shrunk rate of failing documents is over this.
MOST_FAILING = 0.5

#: Weight of the prior in documents if the rates of the hosts don't differ.
FLAT_PRIOR = 100.0

#: The same at most, where the rates differ no more than by chance.
STRONGEST_PRIOR = 1000.0

#: Hosts up to this number are sent to all tasks; more are joined by a shuffle.
HOSTS_TO_SEND = 50_000


def _next(array: str, i: Column, step: int) -> Column:
    return F.get(F.col(array), i + step)


def text_measures(df: DataFrame, keep: list[str]) -> DataFrame:
    """Counts of every text; keep names the columns to carry along. The text is in the column text."""
    text = F.col("__text")
    rows = df.select(*keep, text_of().alias("__text"))
    rows = settle(rows, {
        "__words": F.regexp_extract_all(text, F.lit(SPACED_WORD), F.lit(0)),
        "__lines": F.filter(F.split(text, "\n"), lambda line: line.rlike(SPACED_WORD)),
        "word_chars": F.char_length(F.regexp_replace(text, SPACES, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
    }).drop("__text")
    rows = settle(rows, {
        "n_words": F.size("__words").cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__triples": F.sort_array(F.slice(
            F.transform("__words", lambda word, i: F.struct(
                F.xxhash64(word, _next("__words", i, 1), _next("__words", i, 2)).alias("h"), i.alias("at")
            )), 1, F.greatest(F.size("__words") - 2, F.lit(0)),
        )),
    }).drop("__words", "__lines")
    rows = settle(rows, {"__starts": F.sort_array(F.transform(
        F.filter("__triples", lambda x, i: (
            ((i > 0) & (F.get(F.col("__triples"), i - 1)["h"] == x["h"])) | F.coalesce(_next("__triples", i, 1)["h"] == x["h"], F.lit(False))
        )), lambda x: x["at"],
    ))}).drop("__triples")
    covered = F.transform("__starts", lambda at, i: F.least(F.lit(3), F.coalesce(_next("__starts", i, 1), at + 3) - at))
    return rows.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0), lambda a, b: a + b).cast("long")).drop("__starts")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def soft_failed() -> Column:
    return (
        (100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines"))
        | (F.col("word_chars") < SHORTEST_MEAN * F.col("n_words"))
        | (F.col("word_chars") > LONGEST_MEAN * F.col("n_words"))
    )


def host_rates(judged: DataFrame, host: str) -> DataFrame:
    """host, documents, failed and the rate shrunk by the prior that all hosts give.

    The rates of hosts differ by chance even where all are alike, the more the fewer documents they have. By
    the moments of the beta-binomial their variance is m (1 - m) (h + (1 - h) / (weight + 1)), h being the mean of
    1 / documents; where nothing is left beyond chance, the prior is as strong as it may be.
    """
    hosts = staged(judged.groupBy(host).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("base_failed") | F.col("soft_failed")).alias("failed")
    ))
    rate = F.col("failed") / F.col("documents")
    row = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("variance"), F.avg(1 / F.col("documents")).alias("chance")).first()
    mean, variance, chance = row["mean"] or 0.0, row["variance"] or 0.0, row["chance"] or 1.0
    weight = FLAT_PRIOR
    if variance > 1e-12:
        alike = (variance / (mean * (1 - mean)) - chance) / (1 - chance) if chance < 1 else 0.0
        weight = max(1 / alike - 1, 1.0) if alike * (STRONGEST_PRIOR + 1) > 1 else STRONGEST_PRIOR
    return hosts.withColumn("rate", (F.col("failed") + mean * weight) / (F.col("documents") + weight))


def judge_quality(df: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, the counts, base_failed, soft_failed, host_failed and kept."""
    rows = df.select("doc_id", "text", F.col(f"`{host}`").alias("host"))
    measured = text_measures(rows, ["doc_id", "host"])
    judged = staged(measured.withColumn("base_failed", base_failed()).withColumn("soft_failed", soft_failed()))
    rates = staged(host_rates(judged, "host").select(F.struct("host").alias("of"), (F.col("rate") > MOST_FAILING).alias("host_failed")))
    if rates.count() <= HOSTS_TO_SEND:
        rates = F.broadcast(rates)
    back = judged.join(rates, F.struct("host") == F.col("of")).drop("of")
    return back.withColumn("kept", ~F.col("base_failed") & ~(F.col("host_failed") & F.col("soft_failed")))
