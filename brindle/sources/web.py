"""URL work of a crawl, on tables: discovery, slugs, rules, relevance.  Fetching pages is outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..lineage import cut


def slug(url: Column) -> Column:
    path = F.btrim(F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z]+://[^/]*", ""), r"[?#].*$", ""), F.lit("/"))
    name = F.regexp_replace(F.replace(path, F.lit("/"), F.lit("__")), "[^A-Za-z0-9_.-]", "-")
    return F.substring(F.when(name == "", "index").otherwise(name), 1, 120)


def sitemap_urls(sitemaps: DataFrame, include: str = ".", exclude: str = "^$", most: int = 200) -> DataFrame:
    """The distinct URLs of sitemap texts (seq, xml) in first-seen order, without fragments and end slashes."""
    found = sitemaps.select("seq", F.posexplode(F.regexp_extract_all("xml", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("n", "loc"))
    url = F.regexp_replace(F.regexp_replace("loc", "#.*$", ""), "/+$", "")
    found = found.withColumn("url", url).filter(F.col("url").rlike(include) & ~F.col("url").rlike(exclude))
    first = found.groupBy("url").agg(F.min(F.struct("seq", "n")).alias("at"))
    return first.orderBy("at").limit(most).select("url")


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """URLs (host, path) that no disallowed prefix of their host covers; hosts without rules allow all."""
    barred = rules.filter("prefix <> ''")
    return urls.join(barred, (urls.host == barred.rule_host) & urls.path.startswith(barred.prefix), "left_anti")


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """host, pattern, allow: the rules of robots.txt texts (host, text) that hold for ``agent``.

    Comments, blank and unknown lines are left out.  User-agent lines in a row open a group; the rules after them are
    the group's.  The groups that name the agent hold, in any case of letters; only where none does, those of "*".
    An empty pattern bars nothing.
    """
    lines = robots.select("host", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r\n|\r|\n", -1)).alias("n", "line"))
    plain = F.regexp_replace("line", "#.*$", "")
    told = lines.select("host", "n", F.lower(F.trim(F.split_part(plain, F.lit(":"), F.lit(1)))).alias("field"), F.trim(F.regexp_replace(plain, "^[^:]*:?", "")).alias("value"))
    told = told.filter(F.col("field").isin("user-agent", "allow", "disallow"))
    order = W.partitionBy("host").orderBy("n")
    is_agent = F.col("field") == "user-agent"
    opens = is_agent & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    told = told.withColumn("opens", opens.cast("int")).withColumn("group", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    told = told.withColumn("own", F.when(is_agent, F.when(F.lower("value") == agent.lower(), 2).when(F.col("value") == "*", 1).otherwise(0)))
    told = told.withColumn("rank", F.max("own").over(W.partitionBy("host", "group"))).withColumn("best", F.max("own").over(W.partitionBy("host")))
    holds = ~is_agent & (F.col("best") > 0) & (F.col("rank") == F.col("best")) & (F.col("value") != "")
    return told.filter(holds).select("host", F.col("value").alias("pattern"), (F.col("field") == "allow").alias("allow")).distinct()


def judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The urls (host, path, ...) with ``allowed``: by the longest pattern of their host that matches, allow before disallow.

    In a pattern "*" stands for any signs and a "$" at its end for the path's end.  Patterns are found by their plain
    beginning: a path meets the lengths that its host's beginnings have, and each beginning by equality; only the rest of a
    pattern is matched.
    """
    start = F.regexp_extract("pattern", r"^[^*$]*", 0)
    quoted = F.regexp_replace("pattern", r"([\\.+?^()\[\]{}|])", r"\\$1")
    regex = F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\$(?!$)", r"\\\$"))
    known = rules.select("host", "allow", "pattern", start.alias("start"), F.length(start).alias("size"), regex.alias("regex"))
    sizes = known.groupBy("host").agg(F.collect_set("size").alias("sizes"))
    keyed = urls.withColumn("_url", F.monotonically_increasing_id())
    keyed = cut(keyed)
    met = keyed.select("_url", "host", "path").join(sizes, "host").select("_url", "host", "path", F.explode("sizes").alias("size"))
    met = met.filter(F.length("path") >= F.col("size")).withColumn("start", F.substr("path", F.lit(1), F.col("size")))
    hits = met.join(known, ["host", "size", "start"]).filter(F.expr("path rlike regex"))
    best = hits.groupBy("_url").agg(F.max(F.struct(F.length("pattern").alias("size"), "allow")).alias("best"))
    return keyed.join(best, "_url", "left").withColumn("allowed", F.coalesce(F.col("best.allow"), F.lit(True))).drop("_url", "best")


def pdf_relevant(url: Column) -> Column:
    low = F.lower(url)
    return ~low.rlike("|".join(V.PDF_LANGUAGES)) & low.rlike("|".join(V.PDF_KEYWORDS))


def links(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """Distinct same-host links of pages (host, html), PDFs told apart."""
    href = F.regexp_extract_all(html, F.lit(r"""<a\b[^>]*?\bhref\s*=\s*["']([^"'#?]+)"""), F.lit(1))
    found = pages.select(F.col(host).alias("host"), F.explode(href).alias("href"))
    own = F.regexp_extract("href", "^https?://([^/]+)", 1)
    path = F.when(F.col("href").startswith("/"), F.col("href")).when(own != "", F.regexp_replace("href", "^https?://[^/]+", "")).otherwise(F.concat(F.lit("/"), "href"))
    found = found.filter((own == "") | (own == F.col("host"))).select("host", path.alias("path")).distinct()
    return found.withColumn("is_pdf", F.lower("path").endswith(".pdf"))


def resolved(href: Column, base: Column) -> Column:
    """An address against the page it stands on, without fragment; null for other schemes than http.

    Steps up ("../") are taken one after another, ones beyond the root are left out.
    """
    bare = F.regexp_replace(href, "#.*$", "")
    scheme, root = F.regexp_extract(base, "^(https?:)", 1), F.regexp_extract(base, "^(https?://[^/?#]+)", 1)
    path = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "^https?://[^/]+", "")
    folder = F.regexp_replace(path, "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    whole = (
        F.when(bare.rlike("(?i)^https?://"), bare).when(bare.startswith("//"), F.concat(scheme, bare)).when(bare.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), None)
        .when(bare == "", None).when(bare.startswith("/"), F.concat(root, bare)).when(bare.startswith("?"), F.concat(root, path, bare)).otherwise(F.concat(root, folder, bare))
    )
    head, tail = F.regexp_extract(whole, "^(https?://[^/?#]+)", 1), F.regexp_extract(whole, "([?].*)$", 1)
    steps = F.split(F.regexp_replace(F.regexp_replace(whole, "[?].*$", ""), "^https?://[^/]+/?", ""), "/", -1)
    none = F.array().cast("array<string>")
    taken = F.aggregate(
        steps, none,
        lambda done, s: F.when(s == ".", done).when(s == "..", F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)).otherwise(F.concat(done, F.array(s))),
    )
    return F.when(whole.isNotNull() & (head != ""), F.concat(head, F.lit("/"), F.array_join(taken, "/"), tail))


def resolved_links(pages: DataFrame, include: str = ".", exclude: str = "^$") -> DataFrame:
    """host, url and is_pdf of the distinct links of pages (url, html) to their own host, in order."""
    href = F.regexp_extract_all("html", F.lit(r"""<a\b[^>]*?\bhref\s*=\s*["']([^"']*)"""), F.lit(1))
    found = pages.select("url", F.explode(href).alias("href"))
    found = found.select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_replace(resolved(F.col("href"), F.col("url")), "/+$", "").alias("url"))
    own = F.regexp_extract("url", "^https?://([^/?#]+)", 1) == F.col("host")
    found = found.filter(F.col("url").isNotNull() & own & F.col("url").rlike(include) & ~F.col("url").rlike(exclude)).distinct()
    return found.withColumn("is_pdf", F.lower("url").endswith(".pdf")).orderBy("host", "url")
