"""URL filter: site rules, then logistic regression on hashed character n-grams."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm.common import read

#: The labelled hosts the model learns from (1 = block). Paths below are
#: given to both kinds alike, so that only host names tell them apart.
BAD = (
    "casino-royal.example.com", "online-casino.example.net", "casino-jackpot.example.org",
    "poker-slots.example.com", "free-slots.example.net", "win-slots.example.org",
    "sports-bets.example.com", "best-bets.example.net", "free-betting.example.org",
    "cheap-viagra.example.com", "pills-online.example.net", "diet-pills.example.org",
    "cheap-pharmacy.example.com", "cheap-loans.example.net", "payday-loans.example.org",
    "cheap-replica.example.com", "cheap-watches.example.net", "adult-xxx.example.org",
    "xxx-videos.example.com", "porn-tube.example.net", "hot-dating.example.org",
    "ads-server.example.com", "ads-banner.example.net", "click-ads.example.org",
    "click-track.example.com", "ad-tracker.example.net", "track-pixel.example.org",
    "spam-links.example.com", "link-farm.example.net", "mail-spam.example.org",
    "spam-offers.example.com", "content-farm.example.net", "free-prize.example.org",
    "win-lottery.example.com", "win-iphone.example.net", "free-money.example.org",
    "malware-download.example.com", "phishing-login.example.net", "free-crack.example.org",
    "warez-keygen.example.com", "www.casino-bonus.example.org", "m.adult-chat.example.net",
    "www.adult-cams.example.com", "www.jackpot-win.example.org", "m.free-spins.example.net",
    "www.bonus-win.example.com", "m.casino-slots.example.org",
)
GOOD = (
    "blog.example.com", "news.example.net", "wiki.example.org", "docs.example.com",
    "library.example.net", "university.example.org", "museum.example.com", "city.example.net",
    "health.example.org", "recipes.example.com", "garden.example.net", "weather.example.org",
    "travel.example.com", "science.example.net", "forum.example.org", "shop.example.com",
    "blog.another.example.net", "m.other.example.org", "www.thermal.example.com", "www.either.example.net",
    "blog.together.example.org", "m.weather.example.com", "theatre.example.net", "them.example.org",
    "blog.station.example.com", "m.nation.example.net", "motion.example.org", "www.entire.example.com",
    "able.example.net", "stable.example.org", "blog.north.example.com", "m.earth.example.net",
    "health.example.com", "www.history.example.net", "blog.rather.example.org", "reading.example.com",
    "m.english.example.net", "www.french.example.org", "german.example.com", "spanish.example.net",
    "m.author.example.net", "anthology.example.org", "www.mothering.example.com",
    "m.something.example.net", "north.example.org", "m.thought.example.com",
    "thing.example.net", "other.example.org",
)
PATHS = (
    "/", "/en/", "/de/12", "/fr/345.html", "/es/678/", "/en/901", "/index.html", "/en/23.html",
)
#: Fixed values: (host, path, verdict) rules; a rule holds for the host and its subdomains.
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
#: Characters of an n-gram, hash buckets, and the steps, step size and decay of the descent.
GRAM, BUCKETS, STEPS, RATE, DECAY = 3, 4096, 600, 0.004, 0.005


def labelled() -> list[tuple[int, str, float]]:
    """(id, text, label) of the small table, each host with one of the paths."""
    rows = [(h, 1.0) for h in BAD] + [(h, 0.0) for h in GOOD]
    return [(i, h + PATHS[i % len(PATHS)], y) for i, (h, y) in enumerate(rows)]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return (
        F.coalesce(F.translate(host, upper, lower), F.lit("")),
        F.coalesce(path, F.lit("")),
    )


def buckets(text: Column) -> Column:
    """The distinct hash buckets of a text's character n-grams, ends marked, ascending."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - (GRAM - 1), F.lit(1)))
    return F.array_sort(
        F.array_distinct(
            F.transform(
                starts,
                lambda i: F.conv(F.substr(F.md5(F.substr(marked, i, F.lit(GRAM))), F.lit(1), F.lit(8)), 16, 10)
                .cast("long") % BUCKETS,
            )
        )
    )


def _constant(one: DataFrame) -> DataFrame:
    """The one row of ``one``, computed now, as a row of constants."""
    row = one.select(F.to_json(F.struct(*one.columns))).first()[0]
    return one.sparkSession.range(1).select(
        F.from_json(F.lit(row), one.schema.simpleString()).alias("row")
    ).select("row.*")


def train(spark: SparkSession, rows=None) -> tuple[list[float], float]:
    """Weights per bucket and bias of a logistic regression on ``rows`` (id, text, label).

    Full-batch gradient descent with decay, as DataFrame expressions over the labelled
    table folded into one row (the table is small by contract: its size is the only
    bound, the cost grows with its square). The descent runs on the coefficients of the
    rows, which gives the same weights as a descent on the buckets. Each of the three
    steps is an action of one row, so that no later one repeats an earlier one.
    """
    table = spark.range(1).select(
        F.inline(F.array(*[
            F.struct(F.lit(i).cast("long").alias("id"), F.lit(t).alias("text"), F.lit(float(y)).alias("y"))
            for i, t, y in (rows or labelled())
        ]))
    )
    all_rows = table.select("id", "y", buckets(F.col("text")).alias("g")).agg(
        F.array_sort(F.collect_list(F.struct("id", "y", "g"))).alias("xs")
    )
    xs = _constant(all_rows)
    kernel = xs.select(
        F.transform(
            "xs",
            lambda a: F.transform(
                F.col("xs"), lambda b: (F.size(F.array_intersect(a["g"], b["g"])) + 1).cast("double")
            ),
        ).alias("k"),
        F.transform("xs", lambda a: a["y"]).alias("y"),
    )

    def step(a, _):
        margin = lambda i: F.aggregate(
            F.zip_with(F.get("k", i), a, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v
        )
        return F.transform(
            a,
            lambda v, i: v
            - F.lit(RATE) * (1 / (1 + F.exp(-margin(i))) - F.get("y", i))
            - F.lit(RATE * DECAY) * v,
        )

    fitted = _constant(kernel).select(
        F.aggregate(
            F.sequence(F.lit(1), F.lit(STEPS)), F.transform("y", lambda _: F.lit(0.0)), step
        ).alias("a")
    )
    a = F.lit(list(fitted.first()["a"]))
    got = xs.select(
        F.transform(
            F.sequence(F.lit(0), F.lit(BUCKETS - 1)),
            lambda b: F.aggregate(
                F.zip_with("xs", a, lambda x, v: F.when(F.array_contains(x["g"], b.cast("long")), v).otherwise(F.lit(0.0))),
                F.lit(0.0), lambda s, v: s + v,
            ),
        ).alias("w"),
        F.aggregate(a, F.lit(0.0), lambda s, v: s + v).alias("b"),
    ).first()
    return list(got["w"]), got["b"]


def score(text: Column, weights: list[float], bias: float) -> Column:
    """Log odds of block."""
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    return F.aggregate(
        F.transform(buckets(text), lambda b: F.get(table, b.cast("int"))),
        F.lit(bias), lambda s, v: s + v,
    )


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits (host + path) and its verdict; null when none does."""
    name = verdict = None
    for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return name, verdict


def judge(pages: DataFrame, url: str = "url", model: tuple[list[float], float] | None = None) -> DataFrame:
    """``pages`` plus host, path, rule, log_odds and verdict (allow or block).

    A rule decides where one fits, else the model: log odds above 0 block. A null URL
    or one without ``://`` has empty host and path and the model's verdict for the empty
    text. Rows are judged one by one, without a shuffle: repeated rows repeat, an empty
    table stays empty, other columns stay and those of the five names are replaced.
    """
    weights, bias = model or train(pages.sparkSession)
    host, path = parts(F.col(url))
    named = pages.withColumns({"host": host, "path": path})
    name, verdict = rule_of(F.col("host"), F.col("path"))
    odds = score(F.concat("host", "path"), weights, bias)
    return named.withColumns({"rule": name, "log_odds": odds}).withColumn(
        "verdict", F.coalesce(verdict, F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    )


def query(spark, sf_dir):
    return judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _grams(source: str, text: str) -> str:
    return f"""
  SELECT *, list_sort(list_distinct(list_transform(
    range(1, greatest(length({text}) + 2 - {GRAM - 1}, 1) + 1),
    lambda i: ('0x' || substr(md5(substr('^' || {text} || '$', i, {GRAM})), 1, 8))::BIGINT % {BUCKETS}))) AS g
  FROM {source}"""


def _sql() -> str:
    rows = ", ".join(f"({i}, '{t}', {y}::DOUBLE)" for i, t, y in labelled())
    fits = [
        (f"(host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}')", h + p, v)
        for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    ]
    rule = " ".join(f"WHEN {f} THEN '{n}'" for f, n, _ in fits)
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits)
    return f"""
WITH RECURSIVE lab AS (SELECT * FROM (VALUES {rows}) AS t(id, text, y)),
labg AS ({_grams("lab", "text")}),
k AS (
  SELECT list(r ORDER BY id) AS k, list(y ORDER BY id) AS y FROM (
    SELECT a.id, a.y, list(len(list_intersect(a.g, b.g)) + 1.0::DOUBLE ORDER BY b.id) AS r
    FROM labg a, labg b GROUP BY a.id, a.y)),
descent AS (
  SELECT 0 AS step, list_transform(y, lambda v: 0.0::DOUBLE) AS a FROM k
  UNION ALL
  SELECT step + 1, list_transform(a, lambda v, i:
    v - {RATE}::DOUBLE * (1.0::DOUBLE / (1.0::DOUBLE + exp(-list_dot_product(list_extract(k.k, i)::DOUBLE[], a))) - list_extract(k.y, i))
      - {RATE * DECAY}::DOUBLE * v)
  FROM descent, k WHERE step < {STEPS}),
fitted AS (SELECT a FROM descent WHERE step = {STEPS}),
w AS (
  SELECT b, sum(v) AS w FROM (
    SELECT unnest(g) AS b, list_extract(a, id + 1) AS v FROM labg, fitted) GROUP BY b),
url AS (
  SELECT row_number() OVER () AS rid, page_id,
         coalesce(regexp_extract(url, '^.*?://(.*)$', 1, 's'), '') AS rest FROM pages),
part AS (
  SELECT rid, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM url),
ug AS ({_grams("(SELECT *, host || path AS t FROM part)", "t")}),
odds AS (
  SELECT rid, sum(coalesce(w.w, 0)) AS s
  FROM (SELECT rid, unnest(g) AS b FROM ug) u LEFT JOIN w ON u.b = w.b GROUP BY rid)
SELECT page_id, host, path, CASE {rule} END AS rule,
       coalesce(CASE {verdict} END,
                CASE WHEN odds.s + (SELECT list_sum(a) FROM fitted) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM part JOIN odds ON part.rid = odds.rid
"""


SQL = _sql()
