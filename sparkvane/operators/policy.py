"""Votes to threat levels, and the rules around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Threat level by number of votes.
THREAT = {0: "LOW", 1: "MEDIUM", 2: "HIGH", 3: "HIGH"}
# Limits of the simulated signals.
SIGNALS = {"sttl": 100.0, "sload": 1e6, "smean": 300.0}
# Of each model's simulated probability the base, step and limit at two signals or more, the value at one, and the start and limit at none.
SIMULATED = {"svm": (0.62, 0.10, 0.97, 0.61, 0.88, 0.04), "rf": (0.68, 0.08, 0.98, 0.44, 0.91, 0.03), "qsvc": (0.58, 0.10, 0.94, 0.39, 0.85, 0.06)}
PER_BYTE = 3e-6
# Example flows with the votes and the level they must get.
PRESETS = [("quiet", 0, "LOW"), ("odd", 1, "MEDIUM"), ("contested", 2, "HIGH"), ("attack", 3, "HIGH")]


def decide(df: DataFrame, preds: list[str]) -> DataFrame:
    """df with votes, final, threat, review, reason and tally."""
    votes = sum((F.col(p) for p in preds[1:]), F.col(preds[0]))
    threat = F.create_map(*(F.lit(x) for kv in THREAT.items() for x in kv))[F.col("votes")]
    split = F.col("votes").isin(1, 2)
    return df.withColumn("votes", votes).withColumns({"final": (F.col("votes") >= 2).cast("int"), "threat": threat, "review": split, "reason": F.when(split, F.concat(F.lit("models disagree: "), F.col("votes").cast("string"), F.lit(" of 3 see an attack"))), "tally": F.concat(F.col("votes").cast("string"), F.lit("/3"))})


def at_threshold(probability: Column, threshold: float = 0.5) -> Column:
    return (probability >= F.lit(float(threshold))).cast("int")


def simulated_votes(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with signals, a prediction and a probability of each model, votes, final, threat and review, for use without models; `simulated` is always true.

    columns names the columns of sttl, sload, smean and sbytes. Two signals or more convince all three
    models, one convinces the first; without signals the probabilities fall with the bytes sent.
    """
    count = sum(((F.col(columns[k]) > v).cast("int") for k, v in list(SIGNALS.items())[1:]), (F.col(columns["sttl"]) > SIGNALS["sttl"]).cast("int"))
    out, n = df.withColumn("signals", count), F.col("signals")
    made = {}
    for m, (base, step, most, one, calm, least) in SIMULATED.items():
        made[f"{m}_pred"] = ((n >= 2) | ((n == 1) & F.lit(m == "svm"))).cast("int")
        quiet = F.greatest(F.lit(least), F.lit(calm) - F.col(columns["sbytes"]) * F.lit(PER_BYTE))
        made[f"{m}_probability"] = F.round(F.when(n >= 2, F.least(F.lit(most), F.lit(base) + n * F.lit(step))).when(n == 1, F.lit(one)).otherwise(quiet), 6)
    return decide(out.withColumns(made), [f"{m}_pred" for m in SIMULATED]).withColumn("simulated", F.lit(True))


def summary(decided: DataFrame) -> DataFrame:
    """Counts by threat level, decision and review flag."""
    return decided.groupBy("threat", "final", "review", "tally").agg(F.count("*").alias("n"), F.sum("y").alias("attacks"))
