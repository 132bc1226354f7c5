"""Feedback and observations folded into weights, reliabilities and choices."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsignal.functions.scores import feedback_reward, initial_reliability
from postsignal.operators.ordered import fold_clamped, range_chunks
from postsignal.policies import ThrottlePolicy, WeightPolicy
from postsignal.runtime import materialize


def rewarded_feedback(
    feedback: DataFrame, suggestions: DataFrame | None = None, rewards: Mapping[str, float] | None = None
) -> DataFrame:
    """Feedback with its weight key ``tone.<variant>`` and reward.

    With a suggestions table (suggestion_id, variant_label) feedback on unknown suggestions drops
    out; otherwise ``feedback`` carries ``variant_label`` itself.
    """
    rows = feedback
    if suggestions is not None:
        known = suggestions.select("suggestion_id", "variant_label")
        rows = feedback.drop("variant_label").join(known, "suggestion_id")
    return rows.withColumn("key", F.concat(F.lit("tone."), F.col("variant_label"))).withColumn(
        "reward", feedback_reward(F.col("action"), rewards)
    )


def folded_weights(
    rewarded: DataFrame, order: Sequence[str] = ("ts", "event_id"), start: DataFrame | None = None,
    policy: WeightPolicy = WeightPolicy(),
) -> DataFrame:
    """Weight of every key after applying its rewards in order, clamped at each step.

    ``start`` holds earlier weights as (key, seed).
    """
    return fold_clamped(
        rewarded, "key", order, F.lit(1.0), F.lit(policy.learning_rate) * F.col("reward"),
        policy.low, policy.high, seed=start, seed_value=policy.start,
    )


def folded_reliability(
    observations: DataFrame, sources: DataFrame | None = None, key: str = "source",
    order: Sequence[str] = ("ordinal",), observed: str = "observed",
) -> DataFrame:
    """Reliability of every source after its observations (moving average, clamped to 0..100).

    ``sources`` (source, source_type) decides the start value; other sources count as unknown.
    """
    seed = None
    if sources is not None:
        seed = sources.select(key, initial_reliability(F.col("source_type")).alias("seed"))
    return fold_clamped(
        observations, key, order, F.lit(0.85), F.col(observed).cast("double") * 0.15, 0.0, 100.0,
        seed=seed, seed_value=30.0,
    )


def style_examples(feedback: DataFrame) -> DataFrame:
    """Edited texts become style examples tagged with the action."""
    return feedback.filter(F.coalesce("edited_text", F.lit("")) != "").select(
        F.col("edited_text").alias("text"), F.col("action").alias("tone_tags"),
        F.lit(65.0).alias("performance_score"), F.lit(True).alias("approved"),
    )


def choose_options(
    options: DataFrame, key: str = "key", option: str = "option", score: str = "score",
    ordinal: str = "ordinal", epsilon: float = 0.0, seed: int = 0,
) -> DataFrame:
    """Epsilon-greedy choice per key.

    Best score wins (missing score 0, ties to the earlier option). With probability ``epsilon``
    the option is drawn evenly instead; the draw is a digest of (key, seed), so a retried task
    makes the same choice.
    """
    def draw(*parts: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", *parts, F.lit(str(seed))), 256)
        return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)

    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0))
    explore = draw(F.col(key).cast("string"), F.lit("explore")) < F.lit(float(epsilon))
    return options.groupBy(key).agg(
        F.max_by(option, F.struct(value, (-F.col(ordinal)).alias("o"))).alias("_best"),
        F.min_by(option, F.struct(draw(F.col(key).cast("string"), F.col(option).cast("string")).alias("d"), F.col(ordinal).alias("o"))).alias("_drawn"),
    ).select(
        key,
        F.when(explore, F.col("_drawn")).otherwise(F.col("_best")).alias("choice"),
        explore.alias("explored"),
    )


# ---------------------------------------------------------------- token buckets


def take_tokens(
    micros: list[int], tokens: float | None, last: int | None, policy: ThrottlePolicy
) -> tuple[list[bool], float | None, int | None]:
    """Run one bucket over ordered event times: (admitted flags, tokens, last update).

    ``tokens`` is None while the bucket does not exist yet.
    """
    flags = []
    for now in micros:
        if tokens is None:
            ok = policy.cost <= policy.capacity
            if ok:
                tokens, last = policy.capacity - policy.cost, now
        else:
            tokens = min(policy.capacity, tokens + max(0.0, (now - last) / 1_000_000) * policy.refill_per_s)
            last = now
            ok = tokens >= policy.cost
            if ok:
                tokens -= policy.cost
        flags.append(ok)
    return flags, tokens, last


def bucket_response(micros: list[int], last: int, policy: ThrottlePolicy) -> list[tuple[float, float, float]]:
    """End tokens of a bucket after the given events as a function of its tokens at ``last``.

    The function is piecewise: from each breakpoint on it is ``slope * x + offset`` with slope 1
    (the start still shows) or 0 (the bucket was full in between). Admitting shifts a piece down
    by the cost, and neighbours that have been shifted alike become one piece again, so there
    are only about ``capacity / cost`` pieces however many events there are.
    """
    cap, cost = policy.capacity, policy.cost
    pieces = [(0.0, 1.0, 0.0)]
    for now in micros:
        refill = max(0.0, (now - last) / 1_000_000) * policy.refill_per_s
        last = now
        changed: list[tuple[float, float, float]] = []
        for i, (low, slope, offset) in enumerate(pieces):
            high = pieces[i + 1][0] if i + 1 < len(pieces) else cap + 1.0
            offset += refill
            parts = [(low, slope, offset)]
            if slope == 0.0:
                parts = [(low, 0.0, min(cap, offset))]
            elif low + offset >= cap:
                parts = [(low, 0.0, cap)]
            elif high + offset > cap:
                parts = [(low, 1.0, offset), (cap - offset, 0.0, cap)]
            for j, (lo, k, o) in enumerate(parts):
                hi = parts[j + 1][0] if j + 1 < len(parts) else high
                if k * lo + o >= cost:
                    changed.append((lo, k, o - cost))
                elif k == 1.0 and hi + o > cost:
                    changed += [(lo, 1.0, o), (cost - o, 1.0, o - cost)]
                else:
                    changed.append((lo, k, o))
        pieces = changed[:1]
        for piece in changed[1:]:
            if piece[1] != pieces[-1][1] or abs(piece[2] - pieces[-1][2]) > 1e-9:
                pieces.append(piece)
    return pieces


def throttle(
    events: DataFrame, key: str, at_us: str, event_id: str, policy: ThrottlePolicy = ThrottlePolicy()
) -> DataFrame:
    """Admit or refuse every event by its key's token bucket: adds ``admitted``.

    A bucket is sequential, but one key may hold most events, so keys are cut into ordered
    chunks. For keys of several chunks every chunk is first reduced, in parallel, to its end
    state as a function of its start state; applying these few small functions in order gives
    the true start of every chunk, and all chunks then run in parallel.
    """
    narrow = events.select(
        F.col(key).cast("string").alias("_key"), F.col(at_us).alias("_us"), F.col(event_id).alias("_id")
    )
    chunked = materialize(range_chunks(narrow, ["_key"], ["_us", "_id"], rows=events.count()))
    ends = chunked.groupBy("_key", "chunk").agg(F.max("_us").alias("_end"))
    # one row per key and chunk: at most one per shuffle partition and key
    starts = ends.withColumn(
        "start_us", F.lag("_end").over(Window.partitionBy("_key").orderBy("chunk"))
    ).drop("_end")
    long_keys = starts.filter("start_us is not null").select("_key").distinct()
    pending = chunked.join(long_keys, "_key", "left_semi").join(starts, ["_key", "chunk"])
    responses = pending.groupBy("chunk").applyInPandas(_responses(policy), _RESPONSE)
    tokens = responses.groupBy("_key").applyInPandas(_chain, "_key string, chunk int, start_tokens double")
    started = starts.join(tokens, ["_key", "chunk"], "left")
    id_type = events.schema[event_id].dataType.simpleString()
    flags = (
        chunked.join(started, ["_key", "chunk"])
        .groupBy("chunk")
        .applyInPandas(_flags(policy), f"_id {id_type}, admitted boolean")
    )
    return events.join(flags.withColumnRenamed("_id", event_id), event_id)


_RESPONSE = "_key string, chunk int, low array<double>, slope array<double>, offset array<double>"


def _runs(rows: pd.DataFrame):
    """(key, first row, event times) of every key in a sorted chunk."""
    keys, micros = rows["_key"].tolist(), rows["_us"].tolist()
    at = 0
    while at < len(keys):
        end = at + 1
        while end < len(keys) and keys[end] == keys[at]:
            end += 1
        yield keys[at], at, micros[at:end]
        at = end


def _responses(policy: ThrottlePolicy):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["_key", "_us", "_id"])
        before = rows["start_us"].tolist()
        out = []
        for key, at, micros in _runs(rows):
            if pd.isna(before[at]):
                _, tokens, _ = take_tokens(micros, None, None, policy)
                pieces = [(0.0, 0.0, -1.0 if tokens is None else tokens)]
            else:
                pieces = bucket_response(micros, int(before[at]), policy)
            out.append((key, rows["chunk"].iloc[0], *(list(column) for column in zip(*pieces))))
        return pd.DataFrame(out, columns=["_key", "chunk", "low", "slope", "offset"])

    return run


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Start tokens of every later chunk of one key from the responses of the chunks before."""
    rows = pdf.sort_values("chunk")
    starts, tokens = [], None
    for low, slope, offset in zip(rows["low"], rows["slope"], rows["offset"]):
        starts.append(tokens)
        at = max(bisect_right(list(low), tokens or 0.0) - 1, 0)
        tokens = slope[at] * (tokens or 0.0) + offset[at]
    out = pd.DataFrame({"_key": rows["_key"], "chunk": rows["chunk"], "start_tokens": starts})
    return out.astype({"start_tokens": "float64"})


def _flags(policy: ThrottlePolicy):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["_key", "_us", "_id"])
        tokens, before = rows["start_tokens"].tolist(), rows["start_us"].tolist()
        admitted = []
        for _, at, micros in _runs(rows):
            # without room for one event no bucket ever comes to exist
            fresh = pd.isna(before[at]) or policy.cost > policy.capacity
            some, _, _ = take_tokens(
                micros, None if fresh else tokens[at], None if fresh else int(before[at]), policy
            )
            admitted += some
        return pd.DataFrame({"_id": rows["_id"].to_numpy(), "admitted": admitted})

    return run


def beta_posteriors(
    outcomes: DataFrame, source: str, good: Column, age: Column, half_life: float, prior: tuple[float, float] = (2.0, 2.0), z: float = 1.645
) -> DataFrame:
    """(source, n, alpha, beta, mean, low, high): reliability of each source as a beta distribution with decay.

    An outcome (``good``, 0 to 1) counts 0.5 ** (age / half_life); ages below zero count as zero, rows with a
    null are left out. ``low`` and ``high`` are ``z`` standard deviations around the mean, within 0 and 1. Sums
    are combined on the map side, so a source with most outcomes sends one row per task.
    """
    known = outcomes.select(F.col(source), good.cast("double").alias("_y"), F.pow(F.lit(0.5), F.greatest(age, F.lit(0)) / half_life).alias("_w")).dropna(subset=["_y", "_w"])
    sums = known.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_w") * F.col("_y")).alias("_g"), F.sum(F.col("_w") * (1 - F.col("_y"))).alias("_b"))
    shaped = sums.select(source, "n", (prior[0] + F.col("_g")).alias("alpha"), (prior[1] + F.col("_b")).alias("beta"))
    total = F.col("alpha") + F.col("beta")
    mean = F.col("alpha") / total
    spread = z * F.sqrt(F.col("alpha") * F.col("beta") / (total * total * (total + 1)))
    return shaped.select("*", mean.alias("mean"), F.greatest(F.lit(0.0), mean - spread).alias("low"), F.least(F.lit(1.0), mean + spread).alias("high"))
