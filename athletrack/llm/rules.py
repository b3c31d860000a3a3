"""Quality rules by document and by host.

Documents are measured one by one; rule failures are summed by host (map-side first), a host's failure rate is
shrunk towards the rate of all hosts by a beta prior that is fitted to the hosts, and hosts whose shrunk rate is
above a limit fail with all their documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athletrack.llm.base import sliced, written

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # of 100 words
HOST_LIMIT = 0.5  # shrunk failure rate above which a host is rejected
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 10_000.0  # of the prior, in documents
BROADCAST_HOSTS = 100_000
SALTS = 64
SYMBOLS = "#*$%&|<>"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that occur twice or more in the text, first occurrences included."""
    if len(words) <= size:
        return 0
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total = reach = 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + size - max(at, reach)
            reach = at + size
    return total


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # on bytes: space and \t to \r
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\v\f\r")),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def metrics(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, the five measures) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = list(map(measure, batch.column(2).to_pylist()))
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(METRICS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "host", *METRICS])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, host string, " + ", ".join(f"{m} long" for m in METRICS)
    return docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col("text").cast("string")).mapInArrow(run, schema)


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, n_docs, n_failed, rate, shrunk, host_kept): one row for each host, null counting as one.

    The prior has the mean of the hosts' rates and, by the method of moments, the weight that explains their spread
    beyond what counting explains.
    """
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    hosts = hosts.withColumn("rate", F.col("n_failed") / F.col("n_docs"))
    fit = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("mean"),
        F.var_samp("rate").alias("spread"),
        F.avg(1 / F.col("n_docs")).alias("inverse"),
    )
    within = F.col("mean") * (1 - F.col("mean"))
    beyond = F.col("spread") - within * F.col("inverse")
    weight = F.when(beyond > 0, within / beyond - 1).otherwise(MOST_WEIGHT)
    weight = F.least(F.greatest(F.coalesce(weight, F.lit(MOST_WEIGHT)), F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT))
    prior = fit.select("mean", weight.alias("weight")).first()
    mean, weight = prior["mean"] or 0.0, prior["weight"]
    shrunk = (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight))
    return hosts.withColumn("shrunk", shrunk).withColumn("host_kept", F.col("shrunk") <= limit)


def judge(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Measures, base rules and verdict for every row.

    Null and empty texts have no words and fail. A null host is a host of its own. Repeated rows each count and each
    give a row, a null doc_id stays null, other columns are not read.
    """
    measured = metrics(docs, host).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    measured = written(measured, "rules")  # numbers only; read twice
    hosts = written(host_verdicts(measured, limit), "rules-hosts").select(F.col("host").alias("of_host"), "shrunk", "host_kept")
    same = F.col("host").eqNullSafe(F.col("of_host"))
    if hosts.count() <= BROADCAST_HOSTS:
        out = measured.join(F.broadcast(hosts), same)
    else:  # a host may hold a third of the rows: its rows go to SALTS places, its verdict to each of them
        salted = hosts.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = measured.withColumn("at", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("at") == F.col("to")))
    return out.select("doc_id", *METRICS, "base_failed", (~F.col("base_failed") & F.col("host_kept")).alias("kept"), "host", F.round("shrunk", 9).alias("host_rate"))
