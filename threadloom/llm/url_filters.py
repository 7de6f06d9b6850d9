"""URL filters: rules, and logistic regression on hashed character n-grams of host and path.

The model is fitted by full-batch gradient descent inside one SQL expression
over the labelled table, which is small by contract (``most`` rows, else an
error), and handed to the scan as a scalar subquery. The built-in table is made
by a rule from two word lists: most of its hosts are ordinary, as most are on
the web, so the intercept lets a host pass that has nothing in common with
either list, and modifiers such as "free" occur on both sides. Judging a table of URLs is one projection:
no shuffle, no Python.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and no n-grams, so the model's intercept judges it; an empty table gives no
row; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Hash buckets of n-grams, lengths of n-grams, and the descent's settings.
BUCKETS, LENGTHS, STEPS, RATE, SHRINK = 1 << 16, (3, 4), 300, 20.0, 1e-5
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: The labelled table's words. Ordinary: institutions, trades, media and studies in four languages.
ORDINARY = """library museum weather history science recipes travel archive journal forum courses physics theatre gallery railway
kitchen council research orchestra garden hospital school university college city gazette times herald tribune daily news observer bank
insurance books music film radio software docs code developer data wiki encyclopedia dictionary maps transport airport hotel
restaurant bakery farm forest river mountain island harbour village church court parliament ministry police health clinic pharmacy dentist
horses birds cycling running tennis football chess poetry painting design architecture engineering mathematics chemistry biology astronomy
geology climate energy solar water motor ferry bibliothek wetter geschichte zeitung gemeinde hochschule handwerk verein bibliotheque musee
meteo histoire mairie ecole cuisine voyages biblioteca tiempo historia ayuntamiento escuela cocina viajes noticias photo video mail office
community network store press review magazine today global national society institute association centre project foundation commons hub
source theory letters public market studio""".split()
#: Unwanted: gambling, sham medicine, adult, fraud and advertising hosts.
UNWANTED = """casino poker slots jackpot roulette betting bets gambling bingo viagra pills meds pharma steroids replica payday loans adult porn
xxx cams escorts hookup sexy nude doubler lottery prize giveaway spam backlinks linkfarm adserver tracker clicks popunder keygen warez
cracked malware phish bookmaker wager freespins cheats leaked dating fetish cialis botnet adclick popads scam ponzi forex""".split()
MODIFIERS = "free best online top my the new real live easy world first open cheap win hot lucky mega buy fast".split()
#: Modifiers from here on are the unwanted hosts' own.
PLAIN = 13
PATHS = ("", "/", "/en/12", "/about", "/2024/05/a-day-out.html", "/wiki/Main_Page", "/docs/guide/", "/de/index.html", "/articles/734", "/es/5/", "/search?q=x", "/fr/contact", "/en/7.html")
UNWANTED_PATHS = ("/bonus", "/win-now", "/free-trial", "/click/88")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table, ``url`` and ``unwanted``: four hosts for each ordinary word, six for each unwanted one."""
    rows = []
    for y, words, modifiers, paths, shapes in ((0, ORDINARY, MODIFIERS[:PLAIN], PATHS, 4), (1, UNWANTED, MODIFIERS, PATHS + UNWANTED_PATHS, 6)):
        for i, word in enumerate(words):
            for k in range(shapes):
                n = shapes * i + k
                modifier, other = modifiers[n % len(modifiers)], words[(7 * i + 11 * k + 3) % len(words)]
                name = (word, f"{modifier}-{word}", f"{other}-{word}", f"{word}{other}", f"{word}-{modifier}", f"{modifier}{word}{n % 100}")[k]
                top = ("com", "org", "net", "de", "fr", "es", "edu", "info")[(n + i) % 8]
                rows.append((f"https://{('', 'www.', 'blog.', 'm.')[(n + i // 3) % 4]}{name}.{top}{paths[(n + i // 5) % len(paths)]}", y))
    values = ", ".join(f"('{u}', {y})" for u, y in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, unwanted)")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for does, text in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, does).otherwise(verdict)
    return rule, verdict


def ngrams(host: Column, path: Column) -> Column:
    """Distinct buckets of the n-grams of ``^host$`` and of the path."""
    found = []
    for kind, text in (("h", F.when(host != "", F.concat(F.lit("^"), host, F.lit("$"))).otherwise("")), ("p", path)):
        chars = F.split(text, "")
        size = F.length(text)
        rest = lambda k: F.slice(chars, k, F.greatest(size - (k - 1), F.lit(0)))  # noqa: B023, E731
        gram = chars
        for n in range(2, max(LENGTHS) + 1):  # each one letter more than the last
            gram = F.zip_with(F.slice(gram, 1, F.greatest(size - (n - 1), F.lit(0))), rest(n), lambda a, b: F.concat(a, b))
            if n in LENGTHS:
                found.append(F.transform(gram, lambda g: F.pmod(F.xxhash64(F.lit(kind), g), F.lit(BUCKETS)).cast("int")))  # noqa: B023
    return F.array_distinct(F.concat(*found))


def fit(labelled: DataFrame, most: int = 2_000) -> DataFrame:
    """One row: ``w``, a weight per bucket, and ``b``, the intercept.

    Descent runs over the buckets that occur in the table; the others keep the weight 0.
    """
    host, path = url_parts(F.col("url"))
    rows = labelled.filter("url is not null and unwanted is not null").select(ngrams(host, path).alias("f"), F.col("unwanted").cast("double").alias("y"))
    table = rows.groupBy().agg(F.array_sort(F.collect_list(F.struct("y", "f"))).alias("rows"))
    table = table.select("rows", F.assert_true(F.size("rows") <= most, "the labelled table is larger than its bound").alias("ok")).filter("ok is null")
    entries = table.select(F.posexplode("rows").alias("i", "r")).select("i", F.explode("r.f").alias("bucket"))
    inverse = entries.groupBy("bucket").agg(F.array_sort(F.collect_list("i")).alias("at"))
    inverse = inverse.groupBy().agg(F.array_sort(F.collect_list(F.struct("bucket", "at"))).alias("inverse"))
    one = table.join(F.broadcast(inverse), F.lit(True))  # one row each
    # buckets by their place among those that occur
    one = one.withColumn("names", F.expr("transform(inverse, c -> c.bucket)"))
    scale = "(1D / sqrt(greatest(1, size(r.f))))"
    # bound by a lambda of their own, else every step would make them anew
    bound = f"array(named_struct('unit', transform(rows, r -> {scale}), 'at', transform(rows, r -> transform(r.f, g -> array_position(names, g) - 1)), 'of', inverse, 'y', transform(rows, r -> r.y)))"
    step = f"""element_at(transform({bound}, s ->
      aggregate(sequence(1, {STEPS}), named_struct('w', array_repeat(0D, size(s.of)), 'b', 0D), (m, t) ->
        element_at(transform(array(
            transform(s.at, (f, i) -> (1D / (1D + exp(-(m.b + s.unit[i] * aggregate(f, 0D, (a, j) -> a + m.w[j])))) - s.y[i]) / size(s.y))),
          e -> named_struct(
            'w', transform(s.of, (c, j) -> m.w[j] - {RATE}D * (aggregate(c.at, 0D, (a, i) -> a + e[i] * s.unit[i]) + {SHRINK}D * m.w[j])),
            'b', m.b - {RATE}D * aggregate(e, 0D, (a, x) -> a + x))), 1))), 1)"""
    fitted = one.select("names", F.expr(step).alias("m"))
    # sorted buckets and their weights become an array with one entry per bucket
    dense = f"""if(size(names) = 0, array_repeat(0D, {BUCKETS}), concat(flatten(transform(names, (x, i) -> concat(
        array_repeat(0D, x - if(i = 0, 0, names[i - 1] + 1)), array(m.w[i])))), array_repeat(0D, {BUCKETS} - 1 - element_at(names, -1))))"""
    return fitted.select(F.expr(dense).alias("w"), "m.b")


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple[tuple[str, str], ...] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """Host, path, rule, verdict and the model's log-odds of every row."""
    model = fit(labelled if labelled is not None else labelled_urls(pages.sparkSession)).select(F.struct("w", "b").alias("m")).scalar()
    host, path = url_parts(F.col("url"))
    named = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    grams = named.withColumn("grams", ngrams(F.col("host"), F.col("path"))).withColumn("m", model)
    total = F.aggregate("grams", F.lit(0.0), lambda a, g: a + F.get(F.col("m.w"), g))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    odds = F.col("m.b") + total / F.sqrt(F.greatest(F.lit(1), F.size("grams")))
    judged = grams.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"), odds.alias("log_odds"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"), "log_odds")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "pages"))
