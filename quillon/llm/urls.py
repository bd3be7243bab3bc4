"""URL filters: rules by host and path, and empirical-Bayes reputation for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, small, stored

#: (verdict, rule): a host with its subdomains, and the start of a path.
RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
]
# Public suffixes of two labels, as far as they are common.
DOUBLE = (
    "ac.jp", "ac.nz", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co",
    "com.hk", "com.mx", "com.my", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "gov.au", "gov.br", "gov.uk", "ne.jp", "net.au",
    "net.cn", "nhs.uk", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk", "sch.uk",
)
#: Bound of the host table for a broadcast.
FEW_HOSTS = 500_000
#: Bounds of a prior's strength, in pages.
STRENGTH = (1.0, 10000.0)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without ://. Only A-Z of the host are lower-cased.

    Plain searches for characters: a url of any length and letters is handled alike.
    """
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.substring_index(F.translate(rest, "?#", "//"), "/", 1)
    path = F.substring_index(F.translate(F.substr(rest, F.char_length(host) + 1), "?", "#"), "#", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, UPPER.lower()), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r)):  # the last that fits wins
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _last(host: Column, labels: int) -> Column:
    parts = F.split(host, "\\.")
    return F.array_join(F.slice(parts, -F.least(F.size(parts), F.lit(labels)), labels), ".")


def public_suffix(host: Column, double: tuple[str, ...] = DOUBLE) -> Column:
    """The last label, or the last two where double lists them."""
    return F.when(_last(host, 2).isin(*double), _last(host, 2)).otherwise(_last(host, 1))


def registered_domain(host: Column, double: tuple[str, ...] = DOUBLE) -> Column:
    """The suffix and one label more."""
    return F.when(_last(host, 2).isin(*double), _last(host, 3)).otherwise(_last(host, 2))


def _strength(level: DataFrame) -> float:
    """The strength of the beta prior that a level's own spread around its parents gives, by moments.

    With children i of n_i pages and bad share p_i around their parent's mean m, let
    S = sum n_i (p_i - m)^2, noise = sum m (1 - m), whole = sum n_i m (1 - m). If all
    spread were chance, S would be noise, and whole if a child's pages were all alike;
    the strength is (whole - S) / (S - noise), within STRENGTH.
    """
    share, chance = F.col("bad") / F.col("n"), F.col("m") * (1 - F.col("m"))
    got = level.where("n > 0").agg(
        F.sum(F.col("n") * (share - F.col("m")) ** 2).alias("s"), F.sum(chance).alias("noise"), F.sum(F.col("n") * chance).alias("whole")
    ).first()
    least, most = STRENGTH
    if got.s is None or got.s <= got.noise:
        return most
    return max(least, min(most, (got.whole - got.s) / (got.s - got.noise)))


def host_reputation(hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, n, bad, posterior, bound): each host's share of bad pages, shrunk level by level.

    hosts: host, domain, suffix, n (labelled pages), bad; a row a host. Suffixes are
    shrunk towards the share of all, registered domains towards their suffix, hosts
    towards their domain, each by a beta prior whose strength the level's own spread
    gives. bound: the posterior mean less z standard deviations. Only sums per group
    and one number a level are needed, so a host with a third of all pages costs no
    more than another.
    """
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = hosts.agg(*sums).first()
    mean = ((whole.bad or 0) + 1) / ((whole.n or 0) + 2)
    up = hosts.select("suffix").distinct().withColumn("m", F.lit(mean))
    for keys in (["suffix"], ["suffix", "domain"], ["suffix", "domain", "host"]):
        level = hosts.groupBy(*keys).agg(*sums).join(up, keys[:-1] or keys)
        k = _strength(level)
        done = level.withColumn("posterior", (k * F.col("m") + F.col("bad")) / (k + F.col("n")))
        up = done.select(*keys, F.col("posterior").alias("m"))
    spread = F.sqrt(F.col("posterior") * (1 - F.col("posterior")) / (k + F.col("n") + 1))
    return done.select("host", "n", "bad", "posterior", (F.col("posterior") - z * spread).alias("bound"))


def url_filter(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[tuple[str, str]] = RULES,
    most_bad: float = 0.2,
    double: tuple[str, ...] = DOUBLE,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, posterior, bound) of every page.

    outcomes: page_id and bad (0 or 1) of the labelled pages; others are null or absent.
    A rule decides where one fits; else the host's reputation: block if the lower bound
    of its bad share is over most_bad. double: public suffixes of two labels. Rows without an outcome, null urls too (host ''),
    are judged alike. Repeated rows give repeated rows.
    """
    host, path = host_and_path(F.col(url_col))
    own = pages.select(F.col(id_col).cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    known = outcomes.where("bad is not null").groupBy("page_id").agg(F.max("bad").cast("int").alias("bad"))
    marked = own.select("page_id", "host").join(known, "page_id", "left")
    hosts = marked.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = hosts.withColumns({"domain": registered_domain(F.col("host"), double), "suffix": public_suffix(F.col("host"), double)})
    fame = host_reputation(stored(hosts, "hosts")).select("host", "posterior", "bound")
    side = F.broadcast(fame) if small(fame, FEW_HOSTS) else fame
    found = own.join(side, "host", "left").withColumn("best", rule_for(F.col("host"), F.col("path"), rules))
    judged = F.when(F.col("bound") > most_bad, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "best.rule", F.coalesce("best.verdict", judged).alias("verdict"), "posterior", "bound")
