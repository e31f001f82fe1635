r"""URL filters: rules first, then link-graph propagation for the hosts that no rule decides.

Trust starts at hosts in proportion to their urls that a rule allows and flows along links (personalised PageRank);
distrust starts at hosts in proportion to their urls that a rule blocks and flows against links. Edges are links to
other hosts found in the pages' href attributes, quoted or not (a relative link stays on its host and adds nothing), and
ties, both ways, between a host and each domain above it, down to the registered one (one name below a public suffix).
A linked host without pages is part of the graph, with the distinct urls that link to it as its urls, and so is a domain
without pages, with none: distrust of one host reaches the others of its domain through it. Links from one host to another
count once a page; parallel ones are summed before anything is shuffled by host, so a hot host is one row for each neighbour.

Scores are whole numbers (fixed point), so sums don't depend on order and reruns agree to the last unit. Rounds go on until
the error left, over all hosts together, is at most ``tolerance`` of one url's share. ``rounds`` may bound them, which cuts
off hosts that are further from any seed.
How much a place in the graph gathers anyway is measured by the same two walks started from all urls alike. A host is
blocked where its distrust is at least ``block_lift`` times what the walk of all urls against links brings it, and its trust,
relative to the walk of all urls along links, is lower than that.

Defined results: a null url, or one without "://", has empty host and path, fits no rule, and is allowed unless the
empty host is judged otherwise; a null html has no links; of rules of equal length the first listed wins; hosts that are
numbers, or longer than names can be (253 characters), have no domain above them; repeated rows count each; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Staging

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UNIT = 1 << 56  # all trust (or distrust) together
LINK = r"(?i)href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>][^\"'\s>]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); A-Z of the host are lower-cased, nothing else."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. Equal lengths: the first listed."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, prefix in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # later ones overrule
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(domain + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def linked_urls(pages: DataFrame) -> DataFrame:
    """(src, urls): for each page with links to a host, its host and the distinct ones as structs (host, path)."""
    parts = lambda u: F.struct(*[c.alias(n) for c, n in zip(url_parts(F.concat(F.lit("://"), u)), ("host", "path"))])
    urls = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), parts))
    return pages.filter(F.rlike("html", F.lit(LINK))).select(F.col("host").alias("src"), urls.alias("urls"))


def linked_hosts(links: DataFrame, hosts: DataFrame, rules) -> DataFrame:
    """(host, urls, allowed, blocked) of hosts that only links name: their distinct linked urls, judged by the rules."""
    urls = links.select(F.explode("urls").alias("u")).select("u.host", "u.path").join(hosts.select("host"), "host", "left_anti").distinct()
    judged = urls.withColumn("_verdict", matching_rule(F.col("host"), F.col("path"), rules)["verdict"])
    return judged.groupBy("host").agg(F.count("*").alias("urls"), F.count_if(F.col("_verdict") == "allow").alias("allowed"), F.count_if(F.col("_verdict") == "block").alias("blocked"))


def host_links(links: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts."""
    targets = F.array_distinct(F.transform("urls", lambda u: u["host"]))
    found = links.select("src", F.explode(targets).alias("dst"))
    return found.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


#: Common suffixes of two labels under which unrelated owners register. A full list is passed as a parameter.
PUBLIC_SUFFIXES = (
    "ac.jp", "ac.uk", "asn.au", "blogspot.com", "co.at", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.bd",
    "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pk", "com.pl", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn",
    "edu.au", "firebaseapp.com", "github.io", "gitlab.io", "go.jp", "gov.au", "gov.uk", "herokuapp.com", "ltd.uk", "ne.jp", "net.au", "net.br", "net.cn", "netlify.app", "or.jp",
    "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk", "pages.dev", "plc.uk", "sch.uk", "vercel.app", "web.app", "wordpress.com",
)


def domain_ties(hosts: DataFrame, suffixes: tuple[str, ...] = PUBLIC_SUFFIXES) -> DataFrame:
    """(src, dst): each host and the domain right above it, and so on up to the registered domain: one label more than a listed suffix, else two labels.

    So hosts under one public suffix have no tie through it.
    """
    names = F.split("host", r"\.")
    named = hosts.filter((F.length("host") <= 253) & ~F.col("host").rlike(r"(^|\.)\d*(:\d*)?$"))
    registered = F.when(F.substring_index(F.regexp_replace("host", r":\d*$", ""), ".", -2).isin(*suffixes), 3).otherwise(2)
    named = named.select(names.alias("names"), registered.alias("labels")).filter(F.size("names") > F.col("labels"))
    suffix = lambda k: F.array_join(F.slice("names", k, F.size("names")), ".")
    steps = F.transform(F.sequence(F.lit(1), F.size("names") - F.col("labels")), lambda k: F.struct(suffix(k).alias("src"), suffix(k + 1).alias("dst")))
    return named.select(F.inline(steps)).distinct()


#: Walk: (where it starts, the weight and the sum of weights by which it moves).
WALKS = {"trust": ("allowed", "along", "along_all"), "fame": ("urls", "along", "along_all"), "distrust": ("blocked", "against", "against_all"), "reach": ("urls", "against", "against_all")}


def walk_table(nodes: DataFrame, edges: DataFrame, staging: Staging, damping: int) -> DataFrame:
    """(a, b, along, along_all, against, against_all, start of each walk): a row for each edge in each direction, and one from each host to itself.

    The row to itself carries what a host starts with (null in the others), and passes on to itself what a host without edges would lose.
    """
    none = [F.lit(0).cast("long").alias("along"), F.lit(1).cast("long").alias("along_all"), F.lit(0).cast("long").alias("against"), F.lit(1).cast("long").alias("against_all")]
    out = {way: edges.groupBy(F.col(end).alias("a")).agg(F.sum("weight").alias(f"{way}_all")) for way, end in (("along", "src"), ("against", "dst"))}
    forth = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("along")).join(out["along"], "a").select("a", "b", "along", "along_all", *none[2:])
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("weight").alias("against")).join(out["against"], "a").select("a", "b", *none[:2], "against", "against_all")
    with_totals = nodes.withColumns({f"{n}_sum": nodes.agg(F.sum(n)).scalar() for n in ("allowed", "blocked", "urls")})
    share = lambda n: F.when(F.col(f"{n}_sum") > 0, (F.lit(UNIT).cast("decimal(38,0)") * F.col(n) / F.col(f"{n}_sum")).cast("long")).otherwise(F.lit(0)).cast("long")
    starts = with_totals.select(F.col("host").alias("a"), *[share(n).alias(k) for k, (n, _, _) in WALKS.items()])
    starts = starts.select("a", *[F.expr(f"cast({k} AS decimal(38,0)) * {1000 - damping} div 1000").cast("long").alias(k) for k in WALKS])
    sink = lambda way: F.when(F.col(f"{way}_all").isNull(), 1).otherwise(0).cast("long").alias(way)
    own = starts.join(out["along"], "a", "left").join(out["against"], "a", "left")
    own = own.select("a", F.col("a").alias("b"), sink("along"), none[1], sink("against"), none[3], *WALKS)
    blank = [F.lit(None).cast("long").alias(k) for k in WALKS]
    return staging.write(forth.select("*", *blank).unionByName(back.select("*", *blank)).unionByName(own), "walks")


def propagate(nodes: DataFrame, edges: DataFrame, staging: Staging, rounds: int | None, damping: float, least: float, at_once: int = 4) -> DataFrame:
    """(host, trust, distrust, fame, reach) in units of ``UNIT``. ``nodes`` has (host, allowed, blocked, urls) counts.

    Trust and fame flow along edges, from what is allowed and from all urls; distrust and reach against them, from what is
    blocked and from all urls: four numbers of one row. A round is one join and one sum. After every ``at_once`` rounds lineage
    is cut, and rounds end if the error that the last change leaves possible, over all hosts together, is at most ``least``
    units (or a unit for each row of the table, which is what whole numbers can tell). Else the first time and every third
    the scores are extrapolated: what two rounds still changed goes on as a geometric series of ``damping`` squared, which is
    exact for ties between hosts and domains and near for the rest. The bound holds from any scores, so that only saves rounds.
    """
    passed = int(damping * 1000)
    table = walk_table(nodes, edges, staging, passed)
    least = max(least, table.count())
    scores, done, k = table.filter("trust IS NOT NULL").selectExpr("a", *[f"{w} AS {w}_now" for w in WALKS], *[f"{w} AS {w}_old" for w in WALKS]), False, 0
    got = [f"sum(cast(cast({w}_now AS decimal(38,0)) * {weight} * {passed} div (cast({total} AS decimal(38,0)) * 1000) AS bigint)) AS {w}_got" for w, (_, weight, total) in WALKS.items()]
    own = [x for w in WALKS for x in (f"max({w}) AS {w}", f"max(if({w} IS NULL, NULL, {w}_now)) AS {w}_old", f"max(if({w} IS NULL, NULL, {w}_old)) AS {w}_older")]
    sums = [F.expr(x) for x in got + own]
    while not done:
        k += 1
        new = table.join(scores, "a").groupBy("b").agg(*sums).selectExpr("b AS a", *[x for w in WALKS for x in (f"{w} + {w}_got AS {w}_now", f"{w}_old", f"{w}_older")])
        if k % at_once == 0 or k == rounds:
            new = staging.write(new, "scores")
            if k > at_once:
                staging.drop(last)
            last = new
            changes = new.agg(*[F.coalesce(F.sum(F.abs(F.col(f"{w}_now") - F.col(f"{w}_old")).cast("double")), F.lit(0.0)) for w in WALKS]).first()
            done = max(changes) * damping / (1 - damping) <= least or k == rounds
            if not done and (k // at_once) % 3 == 1:
                further = [f"greatest(0, cast((cast({w}_now AS decimal(38,0)) * 1000000 - cast({w}_older AS decimal(38,0)) * {passed**2}) div {10**6 - passed**2} AS bigint)) AS {w}_now" for w in WALKS]
                new = new.selectExpr("a", *further, *[f"{w}_old" for w in WALKS])
        scores = new.selectExpr("a", *[x for w in WALKS for x in (f"{w}_now", f"{w}_old")]) if not done else new
    return scores.selectExpr("a AS host", *[f"{w}_now AS {w}" for w in WALKS])


def judge_pages(pages: DataFrame, *, rules=RULES, rounds: int | None = None, damping: float = 0.85, block_lift: int = 1, tolerance: float = 0.01, suffixes: tuple[str, ...] = PUBLIC_SUFFIXES, tie_weight: int = 1) -> DataFrame:
    """(page_id, host, path, rule, verdict, host_trust, host_distrust) for every row.

    ``tie_weight``: the weight of a tie between a host and the domain above it, where a page's link has 1; 0 for links alone.
    """
    staging = Staging(pages.sparkSession, "url-filter")
    host, path = url_parts(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    decided = parsed.withColumn("_found", matching_rule(F.col("host"), F.col("path"), rules))
    counted = decided.groupBy("host").agg(
        F.count("*").alias("urls"), F.count_if(F.col("_found.verdict") == "allow").alias("allowed"), F.count_if(F.col("_found.verdict") == "block").alias("blocked"),
    )
    hosts = staging.write(counted, "hosts")
    links = staging.write(linked_urls(parsed), "links")
    known = staging.write(hosts.unionByName(linked_hosts(links, hosts, rules)), "known")
    ties = staging.write(domain_ties(known if tie_weight else known.limit(0), suffixes), "ties")
    above = ties.select(F.col("dst").alias("host")).distinct().join(known.select("host"), "host", "left_anti")
    nodes = staging.write(known.unionByName(above.select("host", *[F.lit(0).cast("long").alias(n) for n in ("urls", "allowed", "blocked")])), "nodes")
    both = ties.unionByName(ties.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(tie_weight).cast("long"))
    edges = staging.write(host_links(links).unionByName(both), "parts").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    urls = nodes.agg(F.sum("urls")).first()[0] or 1
    scores = propagate(nodes, staging.write(edges, "edges"), staging, rounds, damping, tolerance * UNIT / urls)
    exact = lambda a, b: F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")
    bad = (F.col("distrust") > 0) & (F.col("distrust") >= block_lift * F.col("reach")) & (exact("trust", "reach") < exact("distrust", "fame"))
    verdicts = hosts.join(scores, "host").select("host", F.col("trust").alias("host_trust"), F.col("distrust").alias("host_distrust"), bad.alias("_bad"))
    # A host's verdict joins a page by host, without the html. As a written table it is a plain side of the join, which Spark
    # sends to the pages where its size allows, and beyond that splits the hot host's partition.
    verdicts = staging.write(verdicts, "verdicts")
    staging.keep(verdicts)
    out = decided.drop("html").join(verdicts, "host", "left")
    verdict = F.coalesce(F.col("_found.verdict"), F.when(F.col("_bad"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("_found.rule").alias("rule"), verdict.alias("verdict"), "host_trust", "host_distrust")
