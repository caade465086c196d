"""URL filter: block and allow rules, then a classifier on the URL itself.

The classifier is a logistic regression on hashed character n-grams of host
and path, fitted on the labelled table below (1: block), which is written from
public knowledge of what such hosts are called. Everything runs
in the JVM: the n-grams of a URL are taken and hashed in column expressions,
and the fitted weights, a fixed number of buckets, are one literal array that
the score sums up. No Python runs on the executors and nothing is shuffled.

Rules: a rule is a host and a path. It fits its host and all subdomains if the
URL's path starts with the rule's path; of the rules that fit, the longest
text wins.

Defined results: a null URL or one without ``://`` has an empty host and path
and no n-grams, so its score is the intercept's, which is negative since most
rows of the table are ordinary (allow); URLs of any length are judged whole;
repeated rows are judged each; an empty table gives an empty table.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16384
SIZES = (3, 4, 5)
THRESHOLD = 0.5

#: Host and path of a rule, and its verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

#: Stems of unwanted hosts by kind, what such names put before or after them, well-known names.
STEMS = {
    "adult": "porn porno sex xxx adult nude naked milf hentai erotic fetish camgirls webcams escorts stripper sexcam pornstar hookup",
    "gambling": "casino poker bet bets betting slots slot roulette blackjack jackpot bingo lotto lottery gambling vegas wager sportsbook",
    "pills": "viagra cialis levitra pills pharmacy meds steroids xanax tramadol slimming dietpills",
    "money": "payday loans quickcash forex binary bitcoin crypto getrich profits airdrop moneyfast",
    "piracy": "torrent torrents warez crack cracked keygen serials nulled pirate freemovies fullmovie modapk",
    "fakes": "replica replicas fakewatch rolex giveaway freeprize winner spam spammer phishing clickbait malware",
    "ads": "ads adserver popads popunder banners adclick tracker adnetwork",
}
AROUND = "free best online top hot live cheap my the club hub tube zone city king vip 24 365 world royal mega super star win buy shop girls pro now".split()
KNOWN_UNWANTED = """pornhub.com xvideos.com xnxx.com xhamster.com redtube.com youporn.com tube8.com spankbang.com chaturbate.com
livejasmin.com brazzers.com stripchat.com bongacams.com cam4.com adultfriendfinder.com beeg.com porntrex.com sexu.com xxxbunker.com
youjizz.com motherless.com erome.com literotica.com nudevista.com hentaihaven.xxx rule34.xxx pornpics.com sex.com bet365.com betway.com
888casino.com 888poker.com pokerstars.com partypoker.com ladbrokes.com bwin.com unibet.com betfair.com betvictor.com draftkings.com fanduel.com
1xbet.com betonline.ag bovada.lv stake.com 22bet.com betsson.com betano.com leovegas.com slotomania.com jackpotcity.com spincasino.com
royalvegas.com casinoeuro.com pokerbros.net ggpoker.com thepiratebay.org 1337x.to rarbg.to kickasstorrents.to torrentz2.eu limetorrents.info
yourbittorrent.com fitgirl-repacks.site crackwatch.com nulled.to serials.ws popcash.net popads.net propellerads.com adsterra.com
exoclick.com trafficjunky.com doubleclick.net""".split()
#: Words of ordinary hosts, and well-known ones, some with an unwanted stem inside a plain word.
PLAIN = """news weather library university museum science history recipes garden travel sports music books cinema school hospital
council research journal archive health guide daily post village open data software docs photo kitchen river local maths bird sky
blog times herald tribune gazette review academy college institute society church parish town county state police fire train bus
airport hotel cafe bakery farm forest ocean mountain island harbour bridge castle art design studio print paper press radio film
theatre dance opera piano guitar football cricket tennis cycling running yoga running hiking camping fishing sailing knitting sewing
wood metal stone glass paint build home house family kids baby pets dog cat horse bee flower tree seed soil water energy solar wind
car bike engine motor tool shop market store trade bank insurance law tax job career work office team group network cloud code linux
python java web mobile phone tablet camera video game chess puzzle math physics chemistry biology geology astronomy medicine nurse
doctor dental clinic care support help forum wiki answers learn teach course lesson student teacher language english german french
spanish italian poem story novel author reader magazine digest report letter mail post""".split()
KNOWN_ORDINARY = """wikipedia.org wikimedia.org archive.org nytimes.com bbc.co.uk theguardian.com lemonde.fr spiegel.de zeit.de elpais.com
reuters.com apnews.com nature.com science.org nasa.gov noaa.gov nih.gov who.int europa.eu gov.uk service.gov.uk bund.de loc.gov un.org
mit.edu stanford.edu harvard.edu ox.ac.uk cam.ac.uk ethz.ch essex.ac.uk sussex.ac.uk middlesex.edu wessexwater.co.uk github.com gitlab.com
stackoverflow.com python.org apache.org mozilla.org kernel.org debian.org ubuntu.com w3.org ietf.org arxiv.org jstor.org springer.com
elsevier.com plos.org britannica.com merriam-webster.com dictionary.com imdb.com rottentomatoes.com goodreads.com gutenberg.org
openstreetmap.org weather.com accuweather.com booking.com tripadvisor.com lonelyplanet.com amazon.com ebay.com etsy.com ikea.com
walmart.com target.com bestbuy.com apple.com microsoft.com google.com alphabet.com youtube.com facebook.com linkedin.com reddit.com
medium.com wordpress.com blogspot.com tumblr.com nba.com fifa.com espn.com allrecipes.com epicurious.com webmd.com mayoclinic.org
clevelandclinic.org pharmaceutical-journal.com better.org.uk betterhealth.vic.gov.au betty.org sextant.org sexton.net crackers-and-cheese.com
slothsanctuary.com pokeroot.org casinelli-architects.it lottierose.com analytics.com adulteducation.org livescience.com startribune.com
bingham.edu vegetables.org binaryheap.dev cryptography.io pirateship.com winnipeg.ca wagner.edu""".split()
ORDINARY_PATHS = ["", "/", "/about", "/index.html", "/news/2021/05/12/story.html", "/en/1234", "/wiki/Main_Page", "/articles/77", "/de/seite/5/",
                  "/fr/page.html", "/contact", "/product/123", "/category/item"]
UNWANTED_PATHS = ["/buy", "/free-bonus", "/signup/bonus", "/videos/xxx", "/order/cheap", "/download/full-crack", "/play/win", "/live-sex"]
DOMAINS = ["com", "net", "org", "info", "co.uk", "de", "eu", "biz"]


def labelled_hosts() -> list[tuple[str, float]]:
    """(host, label: 1 unwanted): stems with what stands around them, pairs of plain words, known names.

    Two ordinary hosts for an unwanted one, about, as most hosts are ordinary.
    """
    bad, good = [], []
    for stem in (w for words in STEMS.values() for w in words.split()):
        k = len(bad)
        for i in range(10):
            other, join = AROUND[(7 * k + 5 * i) % len(AROUND)], ("", "-")[(k + i) % 2]
            name = f"{other}{join}{stem}" if i % 2 else f"{stem}{join}{other}"
            bad.append(f"{name}.{DOMAINS[(k + i) % len(DOMAINS)]}")
    words = list(dict.fromkeys(PLAIN))
    for k, word in enumerate(words):
        for i in range(8):
            other = words[(37 * k + 11 * i + 1) % len(words)] if i < 6 else AROUND[(k + i) % len(AROUND)]
            good.append(f"{word}{('', '-')[(k + i) % 2]}{other}.{DOMAINS[(k + i) % len(DOMAINS)]}")
    table = [(h, 1.0) for h in [*bad, *KNOWN_UNWANTED]] + [(h, 0.0) for h in [*good, *KNOWN_ORDINARY]]
    return list(dict(table).items())


def labelled_table(hosts: list[tuple[str, float]] | None = None) -> list[tuple[str, str, float]]:
    """(host, path, label) rows: each host with and without a subdomain, most with an ordinary path."""
    rows = []
    for i, (host, label) in enumerate(labelled_hosts() if hosts is None else hosts):
        for k, sub in enumerate((("", "www."), ("m.", ""), ("blog.", "www."))[i % 3]):
            odd = label and (i + k) % 4 == 0
            paths = UNWANTED_PATHS if odd else ORDINARY_PATHS
            rows.append((sub + host, paths[(3 * i + k) % len(paths)], label))
    return rows


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: dict[str, str] | None = None) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(RULES if rules is None else rules, key=lambda r: (len(r), r)):
        of_host, _, of_path = rule.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith("/" + of_path)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _grams(text: Column, tag: str, size: int) -> Column:
    """Buckets of the character n-grams of one size; the tag keeps host and path apart."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(f"{tag}{size}"), F.substring(text, i, F.lit(size))),
                                                F.lit(BUCKETS)).cast("int"))


def buckets(host: Column, path: Column) -> Column:
    """Distinct buckets of a URL; ^ and $ mark the ends of the host."""
    marked = F.when(F.length(host) > 0, F.concat(F.lit("^"), host, F.lit("$"))).otherwise(F.lit(""))
    return F.array_distinct(F.concat(*[_grams(t, tag, n) for t, tag in ((marked, "h"), (path, "p")) for n in SIZES]))


def train(spark: SparkSession, rows: list[tuple[str, str, float]] | None = None) -> tuple[list[float], float]:
    """Weights of the buckets and the intercept, fitted on the labelled table.

    The regression is Spark's own, over a few thousand rows.
    """
    table = spark.createDataFrame(labelled_table() if rows is None else rows, "host string, path string, label double")
    found = buckets(F.col("host"), F.col("path"))
    names = CountVectorizerModel.from_vocabulary([str(i) for i in range(BUCKETS)], inputCol="found", outputCol="features")
    data = names.transform(table.select("label", found.cast("array<string>").alias("found"))).coalesce(1).cache()
    model = LogisticRegression(maxIter=80, regParam=0.0015, fitIntercept=True, standardization=False).fit(data)
    data.unpersist()
    return model.coefficients.toArray().tolist(), float(model.intercept)


def score(host: Column, path: Column, weights: list[float], intercept: float) -> Column:
    """Probability of label 1. The weights are one constant, parsed when the plan is made."""
    table = F.from_json(F.lit(json.dumps([float(w) for w in weights])), "array<double>")
    total = F.aggregate(buckets(host, path), F.lit(float(intercept)), lambda acc, b: acc + F.get(table, b))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
          model: tuple[list[float], float] | None = None) -> DataFrame:
    """One row per page: id, host, path, the rule that fits, the classifier's score and the verdict."""
    weights, intercept = model or train(pages.sparkSession)
    rows = pages.select(pages[id_col].alias("page_id"), host_of(pages[url_col]).alias("host"),
                        path_of(pages[url_col]).alias("path"))
    rows = rows.withColumn("rule", rule_for(F.col("host"), F.col("path")))
    rows = rows.withColumn("score", score(F.col("host"), F.col("path"), weights, intercept))
    verdict = F.lit(None).cast("string")
    for rule, what in RULES.items():
        verdict = F.when(F.col("rule") == rule, F.lit(what)).otherwise(verdict)
    judged = F.when(F.col("score") >= THRESHOLD, F.lit("block")).otherwise(F.lit("allow"))
    return rows.withColumn("verdict", F.coalesce(verdict, judged))
