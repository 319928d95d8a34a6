"""URL filters with DataFrame and Spark ML functions only: listed rules, then mined association rules.

A listed rule names a host and a path. What the listed rules decide labels the URLs they cover; FP-growth
mines the combinations of URL tokens that go with a label, and the rules that are frequent and sure enough
judge the URLs that no listed rule covers. Tokens that stand in the very same labelled URLs are one item,
else k of them would be 2**k equal rules. An item that never stands beside another label is a rule of its
own and is not mined further: any larger set with it has the same label, no more confidence and no more
support. So k tokens of one site, in whatever combinations, are k rules and not 2**k. Matching goes through an
inverted index: each mined rule hangs on its rarest item, so only URLs with that item are tested against it.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import fresh, materialize, maybe_broadcast, scratch, without

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A rule must be as sure as CONFIDENCE and take away GAIN of the doubt that the label's share alone leaves.
SUPPORT, CONFIDENCE, GAIN = 0.005, 0.9, 0.5
LABEL = "="
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, UPPER.lower())


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _cases(rules, of) -> Column:
    """``of(rule)`` of the longest listed rule that fits columns host and path, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [(((F.col("host") == r[1]) | F.col("host").endswith("." + r[1])) & F.col("path").startswith(r[2]), of(r)) for r in ordered]
    return F.coalesce(*[F.when(test, F.lit(value)) for test, value in fits], F.lit(None).cast("string"))


def tokens(url: Column) -> Column:
    """Sorted distinct tokens: scheme, host labels, path parts and query names; plain numbers are left out."""
    scheme = F.array(F.concat(F.lit("s:"), F.lower(F.coalesce(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.lit("")))))
    labels = F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.split("path", "/"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "")))
    query = F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(""))
    names = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "(?s)^([^=]*)", 1)))
    return F.array_sort(F.array_distinct(F.filter(F.concat(scheme, labels, parts, names), lambda x: F.length(x) > 2)))


def judge(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule (like ``net/``), listed (the rule's verdict or null) and tokens added."""
    pages = without(pages, *({"host", "path", "rule", "listed", "tokens"} - {url_col}))
    pages = pages.withColumn("host", host(F.col(url_col))).withColumn("path", path(F.col(url_col)))
    pages = pages.withColumn("rule", _cases(rules, lambda r: r[1] + r[2])).withColumn("listed", _cases(rules, lambda r: r[0]))
    return pages.withColumn("tokens", F.coalesce(tokens(F.col(url_col)), F.array().cast("array<string>")))


def items(labelled: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(token, item, freq, only): the tokens in a share ``support`` or more of the URLs, item being the first of
    those tokens that are in exactly the same URLs, only their label if they have but one, else null. At most
    (mean tokens a URL) / support rows."""
    least = F.ceil(F.lit(support) * labelled.count())
    seen = labelled.select(F.explode("tokens").alias("token"), F.xxhash64("tokens", "listed").cast("decimal(38,0)").alias("mark"), "listed")
    only = F.when(F.min("listed") == F.max("listed"), F.min("listed")).alias("only")
    seen = seen.groupBy("token").agg(F.count("*").alias("freq"), F.sum("mark").alias("marks"), only).where(F.col("freq") >= least)
    same = seen.groupBy("freq", "marks").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens"), F.min("only").alias("only"))
    return same.select(F.explode("tokens").alias("token"), "item", "freq", "only")


def telling(labelled: DataFrame, known: DataFrame, **bounds) -> DataFrame:
    """The rules of ``mine`` that can be a set's best: items of one label alone, and what is mined of the others.

    A rule that holds an item of one label is sure, as that item is; wherever it fits the item does too, with the
    same verdict and no less support. So what ``match`` says is the same with and without such rules.
    """
    total = labelled.count()
    alone = known.where("token = item and only is not null")
    alone = alone.select(F.array("item").alias("need"), F.col("only").alias("verdict"), F.lit(1.0).alias("confidence"), (F.col("freq") / F.lit(total)).alias("support"), F.col("item").alias("key"))
    return alone.unionByName(mine(labelled, known.where("only is null"), **bounds))


def mine(labelled: DataFrame, known: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, gain: float = GAIN) -> DataFrame:
    """(key, need, verdict, confidence, support) of the mined rules, from columns tokens and listed.

    need holds the items of a rule, key is the rarest of them. URLs are mined with all their frequent items
    (``known``), and ``support`` alone bounds the rules.
    """
    # numbered below the explode, as one select would number the exploded rows
    rows = labelled.select("listed", "tokens", F.monotonically_increasing_id().alias("row")).select("row", "listed", F.explode_outer("tokens").alias("token"))
    told = rows.join(maybe_broadcast(known.select("token", "item")), "token", "left").groupBy("row", "listed").agg(F.collect_set("item").alias("items"))
    baskets = told.select(F.concat("items", F.array(F.concat(F.lit(LABEL), "listed"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    # the label's share of all is confidence / lift, and a sure rule always gains on it
    share = F.col("confidence") / F.col("lift")
    sure = F.col("confidence") >= share + (1 - share) * gain
    found = model.associationRules.where((F.size("consequent") == 1) & F.col("consequent")[0].startswith(LABEL) & sure)
    found = found.select(F.col("antecedent").alias("need"), F.substring(F.col("consequent")[0], 2, 99).alias("verdict"), "confidence", "support")
    freq = known.where("token = item").select("item", "freq")
    keyed = found.withColumn("item", F.explode("need")).join(freq, "item")
    return keyed.groupBy("need", "verdict", "confidence", "support").agg(F.min_by("item", F.struct("freq", "item")).alias("key"))


def match(sets: DataFrame, mined: DataFrame, known: DataFrame) -> DataFrame:
    """(tokens, verdict): for each distinct token set the surest rule whose items it holds, one token of each
    being enough (then the rule of more support, then block). Sets that no rule fits are left out."""
    held = sets.select("tokens", F.explode("tokens").alias("token")).join(maybe_broadcast(known.select("token", "item")), "token")
    held = held.groupBy("tokens").agg(F.collect_set("item").alias("items"))
    hit = held.select("tokens", "items", F.explode("items").alias("key")).join(mined, "key")
    hit = hit.where(F.forall("need", lambda t: F.array_contains("items", t)))
    rank = F.struct("confidence", "support", "verdict")
    return hit.groupBy("tokens").agg(F.max(rank)["verdict"].alias("verdict"))


def filter_urls(pages: DataFrame, url_col: str = "url", rules=RULES, default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict (allow or block) added; columns of these names are replaced.

    Null URLs and URLs without ``://`` have an empty host and path. URLs that neither a listed nor a mined
    rule covers get ``default``. Without labelled URLs nothing is mined. Repeated rows stay repeated.
    """
    pages = without(pages, *({"host", "path", "rule", "verdict"} - {url_col}))
    named = dict(zip(fresh(pages, *(f"page{k}" for k in range(len(pages.columns)))), pages.columns))
    judged = judge(pages.toDF(*named), next(new for new, old in named.items() if old.lower() == url_col.lower()), rules)
    labelled = judged.where("listed is not null").select("tokens", "listed")
    rest = judged.where("listed is null")
    with scratch(pages.sparkSession):
        known = materialize(items(labelled), "url-items")
        mined = materialize(telling(labelled, known), "url-rules")
        # stored, so that a token set of very many URLs is no hot key: few sets are broadcast, many are split by Spark
        verdicts = materialize(match(rest.select("tokens").distinct(), mined, known), "url-verdicts", keep=True)
    rest = rest.join(maybe_broadcast(verdicts), "tokens", "left").withColumn("listed", F.coalesce("verdict", F.lit(default)))
    keep = [F.col(new).alias(old) for new, old in named.items()] + [F.col(c) for c in ("host", "path", "rule")] + [F.col("listed").alias("verdict")]
    return judged.where("listed is not null").select(*keep).unionByName(rest.select(*keep))
