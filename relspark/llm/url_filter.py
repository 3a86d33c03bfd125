"""URL filters: rules first, then the reputation of hosts.

Outcomes of labelled pages give each host's share of bad pages. Few outcomes say little, so each
share is shrunk: a host's towards its registered domain's, that towards its suffix's, that towards
all pages', each with a beta prior whose strength is found from how much the shares differ at that level. A host is
blocked if even the lower bound of its posterior share is above a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relspark.llm.common import materialize
from relspark.operators.joins import join_spread

#: Suffixes of two labels under which domains are registered.
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "co.jp", "ne.jp", "co.nz", "com.br", "co.in", "com.cn", "co.za", "co.kr")
LIMIT = 0.5  # of the share of bad pages
Z = 1.645  # standard deviations from the posterior mean down to the bound: one side, 95 %
#: Least and greatest share of a level's variance that is between its members; strength = 1 / share - 1 outcomes.
LEAST, GREATEST = 0.001, 0.5

Rule = tuple[str, str, str]  # verdict, host, path

_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
_DOC = r"(?s)\A/[^/]*/([0-9]{1,18})(?:[^0-9].*)?\z"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAIL = "|".join(s.replace(".", r"\.") for s in TWO_LABELS)
_SUFFIX = rf"(?s)(?:\A|\.)({_TAIL}|[^.]*)\z"
_DOMAIN = rf"(?s)(?:\A|\.)([^.]*\.(?:{_TAIL})|(?:[^.]*\.)?[^.]*)\z"


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda group: F.coalesce(F.regexp_extract(url, _URL, group), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def site(host: Column) -> Column:
    """The host without user and port, by which reputation goes."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)\A.*@", ""), r":[0-9]*\z", "")


def document_number(path: Column) -> Column:
    """The number of the document that a page shows, from a path like /en/123.html; null if there is none."""
    return F.regexp_extract(path, _DOC, 1).try_cast("long")


def matched(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null without one; of equally long ones that with the longer host.
    Each rule is a branch of one expression, so rules are a list of some hundred, not a table."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, start in reversed(ordered):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def strength(level: DataFrame) -> float:
    """Of a level's beta prior, from its members' outcomes n, bad and the mean of what they belong to, by moments: for members of that mean m,
    (bad - n m)^2 is n m (1 - m) (1 + (n - 1) share) on average. share is the part of the variance between members."""
    v = F.col("m") * (1 - F.col("m")) * F.col("n")
    r = level.agg(F.sum(F.pow(F.col("bad") - F.col("n") * F.col("m"), 2) - v).alias("over"), F.sum(v * (F.col("n") - 1)).alias("base")).first()
    share = r["over"] / r["base"] if r["base"] else LEAST
    return 1 / min(max(share, LEAST), GREATEST) - 1


def reputations(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(site, bad_rate, bad_bound) for each site of hosts (site): the posterior's mean, and its lower bound.
    outcomes: site, n, bad; a row for each site at most. All sums are made in the tasks first."""
    known = hosts.join(outcomes, "site", "left").select(
        "site", F.regexp_extract("site", _DOMAIN, 1).alias("domain"), F.regexp_extract("site", _SUFFIX, 1).alias("suffix"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("bad", F.lit(0).cast("long")).alias("bad"),
    )
    known = materialize(known)
    add = lambda frame, *by: frame.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = materialize(add(known, "domain", "suffix"))
    suffixes = materialize(add(domains, "suffix"))
    everything = add(suffixes).first()
    mean = ((everything["bad"] or 0) + 0.5) / ((everything["n"] or 0) + 1.0)

    def shrunk(level: DataFrame) -> tuple[DataFrame, float]:
        k = strength(level)
        return level.withColumn("p", (F.col("bad") + F.lit(k) * F.col("m")) / (F.col("n") + F.lit(k))), k

    level, _ = shrunk(suffixes.withColumn("m", F.lit(mean)))
    level, _ = shrunk(join_spread(domains, materialize(level.select("suffix", F.col("p").alias("m"))), "suffix"))
    level, k = shrunk(join_spread(known, materialize(level.select("domain", F.col("p").alias("m"))), "domain"))
    # The posterior is a beta distribution with mean p and n + k outcomes in all.
    bound = F.col("p") - F.lit(Z) * F.sqrt(F.col("p") * (1 - F.col("p")) / (F.col("n") + F.lit(k) + 1))
    return level.select("site", F.col("p").alias("bad_rate"), bound.alias("bad_bound"))


def judge(pages: DataFrame, labelled: DataFrame, rules: list[Rule], limit: float = LIMIT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of pages: id_col, host, path, rule (of the longest rule that fits; else null), verdict (allow or block: the rule's, else block if
    the bound of the host's posterior is above the limit), bad_rate and bad_bound (6 digits) of its host.

    labelled: pages (url_col, bad boolean) whose outcome is known; rows without one say nothing. A null url, or one without ://, has an empty host and
    path, and the reputation of that host. Null and repeated ids are kept, a row each. Without any outcome the mean is one half, and no host is blocked.
    An empty table gives an empty result; other columns are not read.
    """
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path")).withColumn("site", site(F.col("host")))
    known = labelled.where(F.col("bad").isNotNull()).select(site(host_and_path(F.col(url_col))[0]).alias("site"), F.col("bad").cast("long").alias("bad"))
    outcomes = known.groupBy("site").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    reputation = materialize(reputations(parsed.select("site").distinct(), outcomes))
    met = join_spread(parsed, reputation, "site").withColumn("_rule", matched(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("_rule.verdict", F.when(F.col("bad_bound") > limit, F.lit("block")).otherwise(F.lit("allow")))
    six = lambda c: F.round(c, 6) + F.lit(0.0)
    return met.select(F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), six("bad_rate").alias("bad_rate"), six("bad_bound").alias("bad_bound"))


def outcomes_of(pages: DataFrame, labels: DataFrame, id_col: str = "doc_id", url_col: str = "url") -> DataFrame:
    """(url, bad): pages that show a labelled document, whose number is in their path. Bad: of quality 0, or toxic, in any of its labels."""
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    by_document = labels.where(F.col("quality").isNotNull() | F.col("toxic").isNotNull()).groupBy(F.col(id_col).cast("long").alias("_doc")).agg(F.max(bad).alias("bad")).where("_doc is not null")
    shown = pages.select(F.col(url_col).alias("url"), document_number(host_and_path(F.col(url_col))[1]).alias("_doc"))
    return join_spread(shown.where("_doc is not null"), by_document, "_doc").select("url", "bad")


def oracle(rules: list[Rule], limit: float = LIMIT) -> str:
    """DuckDB SQL for `judge` over pages with the outcomes of labels."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    fits = lambda own, start: f"(host = {text(own)} OR ends_with(host, {text('.' + own)})) AND starts_with(path, {text(start)})"
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r))
    rule = "CASE " + " ".join(f"WHEN {fits(own, start)} THEN {text(own + start)}" for _, own, start in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(own, start)} THEN {text(v)}" for v, own, start in ordered) + f" WHEN bad_bound > {limit} THEN 'block' ELSE 'allow' END"

    def shrunk(name: str, key: str, frame: str) -> str:
        moments = f"(SELECT 1 / least(greatest(coalesce(sum((bad - n * m) ** 2 - m * (1 - m) * n) / nullif(sum(m * (1 - m) * n * (n - 1)), 0), {LEAST}), {LEAST}), {GREATEST}) - 1 FROM {name}_in)"
        return f"{name}_in AS MATERIALIZED ({frame}), {name}_k AS MATERIALIZED (SELECT {moments} AS k), {name} AS MATERIALIZED (SELECT {key}, n, k, (bad + k * m) / (n + k) AS p FROM {name}_in, {name}_k)"

    return f"""WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), '{_UPPER}', '{_LOWER}') AS host, coalesce(regexp_extract(url, '{_URL}', 2), '') AS path FROM pages),
parsed AS MATERIALIZED (SELECT *, regexp_replace(regexp_replace(host, '(?s)\\A.*@', ''), ':[0-9]*\\z', '') AS site, try_cast(regexp_extract(path, '{_DOC}', 1) AS BIGINT) AS doc FROM u),
lab AS (SELECT doc_id AS doc, max((coalesce(quality = 0, false) OR coalesce(toxic = 1, false))::INT) AS bad FROM labels WHERE (quality IS NOT NULL OR toxic IS NOT NULL) AND doc_id IS NOT NULL GROUP BY doc_id),
per AS (SELECT site, count(bad) AS n, coalesce(sum(bad), 0) AS bad, regexp_extract(site, '{_DOMAIN}', 1) AS domain, regexp_extract(site, '{_SUFFIX}', 1) AS suffix FROM parsed LEFT JOIN lab USING (doc) GROUP BY site),
dom AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM per GROUP BY domain, suffix), suf AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM dom GROUP BY suffix),
{shrunk("s", "suffix", "SELECT suffix, n, bad, (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) FROM suf)::DOUBLE AS m FROM suf")},
{shrunk("d", "domain", "SELECT domain, dom.n, bad, s.p AS m FROM dom JOIN s USING (suffix)")},
{shrunk("h", "site", "SELECT site, per.n, bad, d.p AS m FROM per JOIN d USING (domain)")},
judged AS (SELECT site, p AS bad_rate, p - {Z} * sqrt(p * (1 - p) / (n + k + 1)) AS bad_bound FROM h)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, round(bad_rate, 6) + 0.0 AS bad_rate, round(bad_bound, 6) + 0.0 AS bad_bound FROM parsed JOIN judged USING (site)"""
