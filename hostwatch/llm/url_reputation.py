"""URL filter: explicit rules first, and the reputation of the host where no rule fits.

A host's share of bad pages is a beta-binomial with a prior around its registered domain, the domain's around its public
suffix, the suffix's around all pages.  The strength of the prior at each level comes from how far the shares below it
spread (moments of the beta-binomial), so hosts with few labelled pages lean on their domain and hosts with many on
themselves.  A page is blocked only if the lower bound of its host's posterior exceeds a limit: hosts that nothing is known of stay.

Counts are taken per host first.  Whatever is joined to rows by a host, domain or suffix goes through :func:`with_parent`: keys that hold
more than a thousandth of the rows (at most a thousand keys) are sent to all tasks, the others meet in a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostwatch.llm.common import cut

#: A page is blocked if ``mean - DEVIATIONS * deviation`` of its host's posterior share of bad pages exceeds this share.
LIMIT, DEVIATIONS = 0.25, 1.645
#: Bounds of the correlation inside a group, and so of the strength of a prior.
LEAST_CORRELATION, MOST_CORRELATION = 0.001, 0.9
#: Public suffixes of two labels; any other host's suffix is its last label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr",
                      "com.tw", "edu.au", "gov.au", "gov.uk", "net.au", "or.jp", "org.au", "org.uk")
#: A key with more than one in HOT of the rows is joined by broadcast; there are fewer than HOT of them.
HOT = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #``, A-Z lower-cased; empty for null and where there is no ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #``; empty for null and where there is no ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The public suffix: two labels if listed, else the last one; numeric hosts have none."""
    two = F.substring_index(host, ".", -2)
    return (F.when(host.rlike(r"^[0-9.]*$"), F.lit("")).when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1)))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label before it; a numeric host is its own."""
    two = F.substring_index(host, ".", -2)
    return (F.when(host.rlike(r"^[0-9.]*$"), host).when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two))


def with_parent(rows: DataFrame, parents: DataFrame, key: str, kind: str = "inner") -> DataFrame:
    """``rows`` joined with at most one row of ``parents`` by ``key``, which may be as unevenly spread as it likes."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    least = (counts.agg(F.sum("_n")).first()[0] or 0) // HOT + 1
    hot = F.broadcast(counts.where(F.col("_n") > least).select(key))
    common = rows.join(hot, key, "left_semi").join(F.broadcast(parents.join(hot, key, "left_semi")), key, kind)
    return common.unionByName(rows.join(hot, key, "left_anti").join(parents, key, kind))


def _strength(children: DataFrame) -> float:
    """Strength of the prior from children ``n, bad`` around their parent's share ``prior``: ``1 / correlation - 1``."""
    spread = F.col("prior") * (1 - F.col("prior"))
    s = children.where("n > 0").agg(F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2)).alias("seen"),
                                    F.sum(spread).alias("plain"), F.sum(spread * (F.col("n") - 1)).alias("more")).first()
    correlation = (s.seen - s.plain) / s.more if s.more else LEAST_CORRELATION
    return 1 / min(max(correlation, LEAST_CORRELATION), MOST_CORRELATION) - 1


def reputation(hosts: DataFrame, outcomes: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """``host, labelled, bad, share, bound`` of every row of ``hosts`` (host, each once).

    ``outcomes`` has host, n and bad: how many labelled pages and how many bad ones, in one row or several; rows with a null are
    ignored, hosts that are not in ``hosts`` count for their domain and suffix.  ``share`` is the posterior mean of the
    share of bad pages and ``bound`` its lower bound, 0 at least.  Without any outcome all bounds are 0.
    """
    seen = outcomes.where("host IS NOT NULL AND n > 0 AND bad IS NOT NULL").groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    host = F.col("host")
    known = cut(hosts.select("host").withColumn("asked", F.lit(True)).join(seen, "host", "full")
                .select("host", F.coalesce("asked", F.lit(False)).alias("asked"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"),
                        domain_of(host).alias("domain"), suffix_of(host).alias("suffix")))
    total = known.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    if not total.n:
        return known.where("asked").select("host", F.col("n").alias("labelled"), "bad", F.lit(0.0).alias("share"), F.lit(0.0).alias("bound"))
    domains = cut(known.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = cut(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("prior", F.lit(total.bad / total.n)))

    def shrunk(rows: DataFrame, strength: float) -> DataFrame:
        return rows.withColumn("share", (F.col("bad") + strength * F.col("prior")) / (F.col("n") + strength))

    above = shrunk(suffixes, _strength(suffixes)).select("suffix", F.col("share").alias("prior"))
    domains = cut(with_parent(domains, above, "suffix"))
    above = shrunk(domains, _strength(domains)).select("domain", F.col("share").alias("prior"))
    known = cut(with_parent(known, above, "domain"))
    strength = _strength(known)
    share, weight = F.col("share"), F.col("n") + strength + 1
    bound = F.greatest(share - deviations * F.sqrt(share * (1 - share) / weight), F.lit(0.0))
    return shrunk(known.where("asked"), strength).select("host", F.col("n").alias("labelled"), "bad", "share", bound.alias("bound"))


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, rules``: for every host the rules of it and of the domains above it, the longest first; hosts without one are left out.

    ``rules`` has host, path and verdict.  Ties go to the longer host, then to ``block``.
    """
    known = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").groupBy("host").agg(
        F.collect_set(F.struct((F.length("host") + F.length("path")).alias("long"), F.length("host").alias("host_long"),
                               (F.col("verdict") == "block").alias("first"), "path", F.concat("host", "path").alias("rule"), "verdict")).alias("rules"))
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    above = hosts.select(F.col("host").alias("of"), F.explode(ends).alias("host"))
    found = with_parent(above, known, "host").groupBy("of").agg(F.flatten(F.collect_list("rules")).alias("rules"))
    return found.select(F.col("of").alias("host"), F.sort_array("rules", asc=False).alias("rules"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: DataFrame, limit: float = LIMIT, deviations: float = DEVIATIONS) -> DataFrame:
    """``page_id, host, path, rule, verdict, labelled, bad, bound`` for every row of ``pages`` (page_id, url; more columns are ignored).

    ``rule`` is the longest rule that fits (its host or a host below it, and a path that starts with its path), or null;
    then the verdict is ``block`` where the lower bound of the host's posterior share of bad pages exceeds ``limit``.  Null urls and urls
    without ``://`` have an empty host and path, no rule of a host fits them, and are judged like any other host.  Repeated
    rows and rows with a null id are judged one by one.  ``outcomes`` has host, n and bad, ``rules`` host, path and verdict; empty tables of either are fine.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = cut(parsed.groupBy("host").count().select("host"))
    facts = cut(reputation(hosts, outcomes, deviations).join(rules_by_host(hosts, rules), "host", "left"))
    judged = with_parent(parsed, facts, "host")
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    found = F.when(F.size(fits) > 0, fits[0])
    return (judged.withColumn("found", found)
            .select("page_id", "host", "path", F.col("found.rule").alias("rule"),
                    F.coalesce("found.verdict", F.when(F.col("bound") > limit, "block").otherwise("allow")).alias("verdict"), "labelled", "bad", F.round("bound", 6).alias("bound")))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``host, n, bad`` of pages whose path names a labelled document by its number: bad if the document's quality is 0.

    Pages are counted by host and number before they meet the labels; a document with several labels gives several outcomes,
    pages without a number and labels with a null give none.
    """
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})", 1)
    counted = (pages.select(host_of(F.col("url")).alias("host"), F.when(number != "", number.cast("long")).alias("doc_id")).where("doc_id IS NOT NULL")
               .groupBy("host", "doc_id").agg(F.count("*").alias("n")))
    labelled = labels.where("quality IS NOT NULL").select("doc_id", (F.col("quality") == 0).cast("long").alias("bad"))
    return counted.join(labelled, "doc_id").groupBy("host").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("bad")).alias("bad"))
