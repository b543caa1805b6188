"""URL filters: rules, then empirical-Bayes host reputation.

A rule is a host (with all its subdomains) and a path prefix; of the rules that fit
a URL the longest decides.  Where none fits, the host's reputation does: good and
bad labelled pages are counted for each host, and the beta-binomial posterior of a
host shrinks towards its registered domain, that towards its suffix, and that
towards all pages.  How strongly is estimated at each level from how much rates
differ there (method of moments).  A host is allowed if the lower bound of its
posterior is at least ``least``.

A null URL or one without ``://`` has an empty host and path, fits no rule, and is
judged as a host without labelled pages under the overall rate.  Without any labels
the overall rate is 0.5.  Repeated rows are judged alike; only DataFrame operations
are used, and every grouping is summed before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import stored

#: A suffix has two labels if the first of them is one of these and the last a country's two letters; else it is the last label.
SECOND_LABELS = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "mil", "ne", "net", "nom", "or", "org")
TWO_LABELS = rf"^({'|'.join(SECOND_LABELS)})\.[a-z][a-z]$"
#: Rules that become one expression; more are joined.
EXPRESSION_RULES = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The struct (rule, verdict) of the longest fitting rule of (host, path, verdict), or null.

    Rules become one expression, each asked in turn, which suits some hundreds;
    :func:`with_rules` joins any number.
    """
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        chosen = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _tails(host: Column) -> Column:
    """The host and the domains it lies in."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def with_rules(split: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``_rule``, as :func:`rule_for` gives it, from a table ``host, path, verdict`` of any size.

    Distinct hosts meet the lengths that paths have in rules for their domains, and
    distinct host and path pairs the rules of that host and beginning, so that only rules
    that fit are met.
    """
    given = rules.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("verdict").alias("_v")).where("_h is not null and _p is not null")
    lengths = given.select("_h", F.length("_p").alias("_n")).distinct()
    pairs = stored(split.select("host", "path").distinct(), "host-paths")
    known = pairs.select("host").distinct().select("host", F.explode(_tails(F.col("host"))).alias("_h")).join(lengths, "_h")
    asked = pairs.join(known, "host").where(F.length("path") >= F.col("_n")).withColumn("_p", F.substring(F.col("path"), F.lit(1), F.col("_n")))
    rank = F.struct((F.length("_h") + F.length("_p")).alias("n"), "_h", "_p", "_v")
    best = asked.join(given, ["_h", "_p"]).groupBy("host", "path").agg(F.max(rank).alias("r"))
    best = best.select("host", "path", F.struct(F.concat("r._h", "r._p").alias("rule"), F.col("r._v").alias("verdict")).alias("_rule"))
    return split.join(best, ["host", "path"], "left")


def _levels(host: Column, listed: Column | None = None) -> tuple[Column, Column, Column]:
    """(name, registered domain, suffix) of a host, without its port.  ``listed`` is the host's suffix in a table of such, or null."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    labels = F.split(name, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    address = F.regexp_like(name, F.lit(r"^[0-9.]+$")) | F.startswith(name, F.lit("["))
    n = F.when(F.regexp_like(last(2), F.lit(TWO_LABELS)), 2).otherwise(1)
    if listed is not None:
        n = F.coalesce(F.size(F.split(listed, r"\.")), n)
    domain = F.when(address, name).otherwise(last(n + 1))
    suffix = F.when(address, F.lit("(address)")).otherwise(last(n))
    return name, domain, suffix


def _listed(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Adds ``_listed``: the longest of ``suffixes`` (a column of that singular name) that the host ends in."""
    name = F.regexp_replace("host", r":[0-9]*$", "")
    tails = hosts.select("host", F.explode(_tails(name)).alias("suffix"))
    found = tails.join(suffixes.select("suffix").distinct(), "suffix").groupBy("host").agg(F.max_by("suffix", F.length("suffix")).alias("_listed"))
    return hosts.join(found, "host", "left")


def _strength(groups: DataFrame, parent: str, most: float = 1000.0) -> float:
    """The prior's weight, from how much more the groups' rates differ from the parent's than chance would make them."""
    p, v = F.col("good") / F.col("n"), F.col(parent) * (1 - F.col(parent))
    s, w = groups.where("n > 0").agg(F.sum(F.col("n") * (p - F.col(parent)) * (p - F.col(parent)) - v), F.sum(v * (F.col("n") - 1))).first()
    if not w:
        return 1.0
    return 1 / min(max(s / w, 1 / (most + 1)), 0.5) - 1


def reputation(outcomes: DataFrame, hosts: DataFrame | None = None, least: float = 0.75, z: float = 1.6448536269514722, suffixes: DataFrame | None = None) -> DataFrame:
    """``host, n, good, mean, bound, verdict`` for every host of ``hosts`` and of the outcomes.

    outcomes: ``host, good`` (1 or 0) for each labelled page.  The bound is the
    posterior mean less ``z`` standard deviations, which for few pages may lie below
    zero; it is not a quantile of the beta distribution.  ``suffixes`` may list public
    suffixes, which go before the rule for those of two labels.  Counts for each host are stored
    once; the overall rate and a weight for each level are all that reaches the driver.
    """
    counted = outcomes.where(F.col("good").isin(0, 1) & F.col("host").isNotNull()).groupBy("host").agg(F.sum(F.col("good").cast("long")).alias("good"), F.count("*").alias("n"))
    every = counted if hosts is None else hosts.select("host").distinct().join(counted, "host", "full_outer").na.fill(0, ["good", "n"])
    if suffixes is not None:
        every = _listed(every, suffixes)
    _, domain, suffix = _levels(F.col("host"), None if suffixes is None else F.col("_listed"))
    every = stored(every.select("host", "good", "n", domain.alias("domain"), suffix.alias("suffix")), "host-counts")
    good, n = every.agg(F.sum("good"), F.sum("n")).first()
    overall = good / n if n else 0.5

    def shrunk(groups: DataFrame, parent: str) -> DataFrame:
        m = _strength(groups, parent)
        return groups.withColumns({"a": F.col("good") + m * F.col(parent), "b": F.col("n") - F.col("good") + m * (1 - F.col(parent))})

    mean = F.col("a") / (F.col("a") + F.col("b"))
    sums = [F.sum("good").alias("good"), F.sum("n").alias("n")]
    by_suffix = shrunk(every.groupBy("suffix").agg(*sums).withColumn("overall", F.lit(overall)), "overall").select("suffix", mean.alias("of_suffix"))
    by_domain = shrunk(every.groupBy("domain", "suffix").agg(*sums).join(by_suffix, "suffix"), "of_suffix").select("domain", "suffix", mean.alias("of_domain"))
    by_host = shrunk(every.join(by_domain, ["domain", "suffix"]), "of_domain")
    a, b = F.col("a"), F.col("b")
    bound = mean - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return by_host.select("host", "n", "good", mean.alias("mean"), bound.alias("bound"), F.when(bound >= least, "allow").otherwise("block").alias("verdict"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, url: str = "url", least: float = 0.75, suffixes: DataFrame | None = None) -> DataFrame:
    """Adds ``host, path, rule, verdict`` to every page; columns of those names are replaced.

    rules: a list of (host, path, verdict), or a table of these columns.
    """
    host, path = parts(F.col(url))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.select(*kept, host.alias("host"), path.alias("path"))
    if isinstance(rules, list) and len(rules) <= EXPRESSION_RULES:
        split = split.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    else:
        table = pages.sparkSession.createDataFrame(rules, "host string, path string, verdict string") if isinstance(rules, list) else rules
        split = with_rules(split, table)
    known = reputation(outcomes, split.where("_rule is null").select("host"), least, suffixes=suffixes).select("host", F.col("verdict").alias("_known"))
    joined = split.join(known, "host", "left")
    return joined.select(*kept, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", "_known").alias("verdict"))
