"""Access policy: the one rule that governs a repository, and what it grants."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.globs import literal_length, stars, to_regex

#: The bits of an action set.
PULL, PUSH, DELETE = 1, 2, 4
#: Rules at most; each one's pattern is compiled into the plan.
MAX_RULES = 10_000


def winning_rules(repos: DataFrame, rules: list[tuple[int, str]]) -> DataFrame:
    """repos: repo; rules: (place of declaration, pattern). repo, rule: the place of the matching rule with the most
    literal characters, then the fewest stars, then the first declared; null if none matches.

    Rules are policy, a bounded list on the driver: sorted once by that order, the first match in a chain of patterns
    wins, so every repository is decided on its own, without a join."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    order = sorted(rules, key=lambda r: (-literal_length(r[1]), stars(r[1]), r[0]))
    won = F.coalesce(*[F.when(F.col("repo").rlike(to_regex(p)), F.lit(i)) for i, p in order], F.lit(None).cast("int"))
    return repos.withColumn("rule", won.cast("int"))


#: Versions of a policy at most; their times go to each worker with the function that looks them up.
MAX_VERSIONS = 100_000


def versions(snapshots: DataFrame, interval: int) -> DataFrame:
    """snapshots: seq, at, valid: each writing of the policy's file, valid if it can be read as a policy. seq, since: those
    that ever come into force, when the file is polled at multiples of interval. What is replaced before a poll is never
    seen; what is invalid when seen leaves the one before in force."""
    since = F.when(F.col("at") <= 0, F.lit(0)).otherwise(F.ceil(F.col("at") / interval) * interval).cast("long")
    seen = snapshots.filter("at IS NOT NULL").groupBy(since.alias("since")).agg(F.max_by(F.struct("seq", "valid"), F.struct("at", "seq")).alias("last"))
    return seen.filter("last.valid").select("last.seq", "since")


def in_force(requests: DataFrame, snapshots: DataFrame, interval: int) -> DataFrame:
    """requests: at. Adds version: the snapshot's seq that is in force then; null before the first, and for a null at.

    Versions are policy, a bounded list on the driver; each request finds its own by bisection, without a join."""
    rows = versions(snapshots, interval).orderBy("since").limit(MAX_VERSIONS + 1).collect()
    if len(rows) > MAX_VERSIONS:
        raise ValueError(f"more than {MAX_VERSIONS} versions of the policy")
    since, seqs = [r["since"] for r in rows], [r["seq"] for r in rows]

    @F.pandas_udf("long")
    def find(at: pd.Series) -> pd.Series:
        place = np.searchsorted(np.asarray(since, np.float64), at.to_numpy(np.float64), side="right") - 1
        found = pd.Series(np.asarray([*seqs, 0], np.int64)[place], dtype="Int64")
        return found.mask((place < 0) | at.isna().to_numpy())

    return requests.withColumn("version", find(F.col("at").cast("double")))


def members(groups: DataFrame) -> DataFrame:
    """groups: name, user. user, groups: each user's groups."""
    return groups.groupBy("user").agg(F.sort_array(F.collect_set("name")).alias("groups"))


def grants(requests: DataFrame, winners: DataFrame, rules: DataFrame, policies: DataFrame, groups: DataFrame, admins: DataFrame) -> DataFrame:
    """requests: user (null: anonymous), repo. Adds actions: all for admins, else the bits of the winning rule alone: its
    anonymous bits; for a user together with its bits for all users and those of each of its policies that names the user
    or one of the user's groups.

    rules: rule, anonymous, authenticated; policies: rule, users, groups, actions."""
    named = policies.select("rule", F.explode("users").alias("user"), "actions")
    through = policies.select("rule", F.explode("groups").alias("name"), "actions").join(groups, "name").select("rule", "user", "actions")
    bits = named.unionByName(through).groupBy("rule", "user").agg(F.bit_or("actions").alias("_own"))
    admin = admins.select("user").distinct().withColumn("_admin", F.lit(True))
    out = requests.join(winners.select("repo", "rule").distinct(), "repo", "left").join(rules, "rule", "left").join(bits, ["rule", "user"], "left").join(admin, "user", "left")
    anyone = F.coalesce("anonymous", F.lit(0))
    own = anyone.bitwiseOR(F.coalesce("authenticated", F.lit(0))).bitwiseOR(F.coalesce("_own", F.lit(0)))
    actions = F.when(F.col("_admin"), F.lit(PULL | PUSH | DELETE)).when(F.col("user").isNull(), anyone).otherwise(own)
    return out.select(*requests.columns, "rule", actions.cast("int").alias("actions"))


def without_policy(requests: DataFrame, auth_enabled: bool) -> DataFrame:
    """Adds allowed where no policy is configured: everything without authentication, else users only."""
    return requests.withColumn("allowed", F.lit(True) if not auth_enabled else F.col("user").isNotNull())


def token_grants(requests: DataFrame) -> DataFrame:
    """requests: repo, action, entries (array of name, actions array). Adds granted: some entry has exactly this name and
    the action."""
    hit: Column = F.exists("entries", lambda e: (e["name"] == F.col("repo")) & F.array_contains(e["actions"], F.col("action")))
    return requests.withColumn("granted", F.coalesce(hit, F.lit(False)))


def valid_claims(tokens: DataFrame, issuer: str, audience: str, now_s: int, leeway_s: int = 30, most_entries: int = 64) -> DataFrame:
    """tokens: iss, aud (array), exp, nbf (seconds, null: none), entries. Adds valid. Signatures aren't looked at."""
    ok = (F.col("iss") == issuer) & F.array_contains("aud", audience) & (F.col("exp") + leeway_s >= now_s)
    ok &= (F.col("nbf").isNull() | (F.col("nbf") - leeway_s <= now_s)) & (F.size(F.coalesce("entries", F.array())) <= most_entries)
    return tokens.withColumn("valid", F.coalesce(ok, F.lit(False)))
