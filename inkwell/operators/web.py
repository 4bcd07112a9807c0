"""Web articles: sites, crawl years and bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import metadata as M
from inkwell.functions import text as T
from inkwell.operators.sizes import small

# The sites that articles are read from, by language.
SITES = {
    "en": (
        "nytimes.com theguardian.com washingtonpost.com latimes.com chicagotribune.com bbc.com bbc.co.uk reuters.com apnews.com npr.org "
        "theatlantic.com newyorker.com economist.com ft.com wsj.com telegraph.co.uk independent.co.uk time.com newsweek.com smithsonianmag.com "
        "nationalgeographic.com scientificamerican.com wired.com arstechnica.com theverge.com vox.com slate.com salon.com politico.com thehill.com "
        "usatoday.com cbsnews.com nbcnews.com abcnews.go.com cnn.com aljazeera.com bostonglobe.com sfchronicle.com baltimoresun.com seattletimes.com "
        "denverpost.com startribune.com theconversation.com propublica.org pbs.org vice.com mashable.com cnet.com zdnet.com engadget.com techcrunch.com"
    ).split(),
    "fr": (
        "lemonde.fr lefigaro.fr liberation.fr lexpress.fr leparisien.fr francetvinfo.fr ouest-france.fr lapresse.ca ledevoir.com radio-canada.ca "
        "courrierinternational.com lepoint.fr nouvelobs.com rfi.fr france24.com slate.fr telerama.fr lesechos.fr latribune.fr 20minutes.fr "
        "huffingtonpost.fr mediapart.fr lamontagne.fr ladepeche.fr sudouest.fr lavoixdunord.fr leprogres.fr ledauphine.com bfmtv.com europe1.fr "
        "francebleu.fr franceculture.fr arte.tv tv5monde.com usinenouvelle.com challenges.fr marianne.net humanite.fr la-croix.com lequipe.fr "
        "sciencesetavenir.fr futura-sciences.com numerama.com clubic.com 01net.com letemps.ch lesoir.be lalibre.be rtbf.be tdg.ch"
    ).split(),
}


def on_sites(rows: DataFrame, sites: DataFrame, url: str = "url") -> DataFrame:
    """rows whose host is a listed site or a subdomain of one, with the longest such site as `site`; repeated rows stay. sites: (site), any number of rows.

    Distinct hosts are cut into their suffixes, which are the keys of an equi-join; rows only meet their host's site.
    """
    hosts = rows.select(M.host(F.col(url)).alias("_host")).where("_host <> ''").distinct()
    cut = hosts.select("_host", F.explode(M.suffixes(F.col("_host"))).alias("site"))
    matched = cut.join(small(sites.select("site").distinct()), "site").groupBy("_host").agg(F.max_by("site", F.length("site")).alias("site"))
    return rows.withColumn("_host", M.host(F.col(url))).join(small(matched), "_host").select(*rows.columns, "site")


def articles(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with the article's body and its number of words instead of the markup."""
    body = pages.withColumn("body", T.clean_article(T.plain_html(F.col(html)))).drop(html)
    return body.withColumn("n_words", T.word_count(F.col("body")))


def is_usable(least: int = M.MIN_ARTICLE_WORDS, most: int = M.MAX_ARTICLE_WORDS) -> Column:
    return F.col("n_words").between(least, most)


def usable(rows: DataFrame) -> DataFrame:
    return rows.where(is_usable())
