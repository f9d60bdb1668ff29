"""URL expressions; all of them are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

AUTHORITY = r"^[a-zA-Z][^:/?#]*://([^/?#]*)"


def link_target(url: Column) -> Column:
    """Canonical form of a stored link: cut at ``#``, scheme http, host in lower case, no ``:80`` or ``:443``.

    Null stays null; a text without ``scheme://`` only loses its fragment.
    """
    bare = F.substring_index(url, "#", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, AUTHORITY, 1)), r":(80|443)$", "")
    rest = F.regexp_replace(bare, AUTHORITY, "")
    return F.when(bare.rlike(r"(?i)^https?://"), F.concat(F.lit("http://"), host, rest)).otherwise(bare)


def has_path(url: Column) -> Column:
    """Whether a ``/`` follows the host."""
    return url.rlike(r"^[a-zA-Z][^:/?#]*://[^/?#]*/")


# Patterns of links that are not worth a visit; each is matched from the start of the link.
USELESS_LINKS = [
    r"^http://en\.wikipedia\.org/w/index\.php", r"^http://en\.wikipedia\.org/wiki/Main_Page", r".+wiki/Help", r"^http://www\.cruiselinefans.+",
    r".*facebook.*", r".*wikimedia.*", r".+share.+", r".+/shop.*", r".+license.*", r".+/blog.*", r".+/copyright.*",
    r"^http://en\.wikipedia\.org/wiki/Wikipedia:", r".*mediawiki.*", r".*language.*", r".+/wiki.+Template:.+", r".+/wiki/Special:.+",
    r".+wiki/Portal:.+", r".+wiki/Talk:.+", r".+wiki.+talk:.+", r".*donate.*", r".*music.*", r".*login.*", r".*food.*", r".*garden.*",
    r".*defence-news.*", r".*exhibitions.*", r".*privacy.*", r".*finance.*", r".*sport.*", r".*horoscope.*", r".*entertainment.*", r".*user.*",
    r".*advertise.*", r".*watsapp.*", r".*book.*", r".*/science/.*", r".*celebrity.*", r".*/travel/.*", r".*style.*", r".*corona.*", r".*art.*",
    r".*literature.*", r".*religion.*", r".*law.*", r".*politics.*", r"^http://en\.m", r"^http://www\.yonhapnews\.co\.kr",
    r"^http://www\.ytn\.co\.kr/", r".*\.jpg$", r".*\.JPG$", r".*\.svg$", r".*\.asp$", r".*\.png$",
]
# Stems and words that raise or lower a link's relevance.
SHIP_WORDS = (
    "uss hms rms ms titan titanic armada submarin ship warship boat maritim marin cruis vessel seoul shipwreck wreckag wreck sink sunk lifeboat submerg "
    "fog rocki sewol mv naval fleet navy liner starship battleship passeng voyag sea nautic fisherman distress"
).split()
DISASTER_WORDS = (
    "earthquak fatal accid disast death rescu survivor rediscov excav tragedi tragic unidentifi recov helicopt doom collid overturn inquiri catastroph danger lost save"
).split()
LAND_WORDS = (
    "aviat airbu boe takeoff jet engin land airlin aerial pilot airplan airway malfunct runway aeroplan plane aircraft airport turbul cockpit debri crash explos "
    "rail railway train line railroad tram electr derail wagon coach"
).split()
NAMED_SHIPS = "dona paz black swan white vasa queen mary rose arizona lusitania sultana republic rms titanic ss kiangya seawise giant eastland wilhelm gustloff rhone".split()


def base_url(url: Column) -> Column:
    """``scheme://host`` of a url, ``://`` of a relative one."""
    return F.concat(F.regexp_extract(url, r"^([a-zA-Z][^:/?#]*)://", 1), F.lit("://"), F.regexp_extract(url, AUTHORITY, 1))


def without_dots(url: Column) -> Column:
    """Url whose path has no ``.`` and ``..`` parts; those that would leave the root are dropped."""
    head = F.regexp_extract(url, r"^([a-zA-Z][^:/?#]*://[^/?#]*)", 1)
    path, rest = F.regexp_extract(url, r"^[a-zA-Z][^:/?#]*://[^/?#]*([^?#]*)", 1), F.regexp_extract(url, r"([?#].*)$", 1)

    def step(done: Column, part: Column) -> Column:
        return F.when(part == "..", F.regexp_replace(done, "/[^/]*$", "")).when(part == ".", done).otherwise(F.concat(done, F.lit("/"), part))

    # a path begins with a slash, so its first part is empty
    clean = F.aggregate(F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/"))), F.lit(""), step)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(head, F.when(clean == "", "/").otherwise(clean), F.when(path.rlike(r"/\.\.?$") & ~clean.endswith("/") & (clean != ""), "/").otherwise(""), rest)).otherwise(url)


def canonical_url(url: Column, parent: Column) -> Column:
    """Canonical form of a link found on page ``parent``.

    ``:80``, ``:443`` and the s of https go wherever they stand, the part from ``#`` goes, a leading ``../``
    or ``/`` is resolved against the parent (what is left of the link may lead further up), parts that are dots go, and scheme and host
    become lower case.
    """
    bare = F.replace(F.replace(F.replace(url, F.lit(":80"), F.lit("")), F.lit(":443"), F.lit("")), F.lit("https"), F.lit("http"))
    bare = F.substring_index(bare, "#", 1)
    folder = F.regexp_replace(F.regexp_replace(parent, r"[?#].*$", ""), r"(://[^/]*/(?:.*/)?)[^/]*$", "$1")
    whole = (
        F.when(bare.startswith("../"), F.concat(folder, F.substring(bare, F.lit(4), F.length(bare))))
        .when(bare.startswith("//"), F.concat(F.regexp_extract(parent, r"^([^/]*)//", 1), bare))
        .when(bare.startswith("/"), F.concat(base_url(parent), bare))
        .otherwise(bare)
    )
    whole = without_dots(whole)
    base = base_url(whole)
    return F.concat(F.lower(F.substring(whole, F.lit(1), F.length(base))), F.substring(whole, F.length(base) + 1, F.length(whole)))


def doc_key(url: Column) -> Column:
    """Url with ``://`` and ``/`` replaced by ``-``; different urls may get the same key, so join on the url."""
    return F.replace(F.replace(url, F.lit("://"), F.lit("-")), F.lit("/"), F.lit("-"))


def useful_link(url: Column) -> Column:
    """Whether a link starts with http://www or http://en and matches none of the useless patterns."""
    return url.rlike(r"^http://(www|en)") & ~url.rlike("^(?:" + "|".join(x.removeprefix("^") for x in USELESS_LINKS) + ")")


def url_keywords(url: Column) -> Column:
    """Keywords of a url: the last part of its path cut at ``.`` and split at ``_`` or else ``-``; the host's second label without a path.

    Empty words are dropped.  A ``Category:`` in the path puts the word Category first, unless one word is left.
    """
    path = F.regexp_extract(url, r"^[a-zA-Z][^:/?#]*://[^/?#]*([^?#]*)", 1)
    parts = F.split(path, "/")
    last = F.when(path.endswith("/"), F.try_element_at(parts, F.lit(-2))).otherwise(F.translate(F.try_element_at(parts, F.lit(-1)), "()'", ""))
    host = F.coalesce(F.try_element_at(F.split(F.regexp_extract(url, AUTHORITY, 1), r"\."), F.lit(2)), F.lit(""))
    name = F.when(path.isin("", "/"), host).otherwise(F.substring_index(last, ".", 1))
    category = path.contains("Category:")
    name = F.when(category, F.regexp_extract(path, "Category:(.*)$", 1)).otherwise(name)
    first = F.when(category, F.array(F.lit("Category"))).otherwise(F.array().cast("array<string>"))
    words = (
        F.when(name.contains("_"), F.concat(first, F.split(name, "_")))
        .when(name.contains("-"), F.concat(first, F.split(name, "-")))
        .otherwise(F.array(name))
    )
    return F.filter(words, lambda x: x != "")


def url_relevance(keywords: Column) -> Column:
    """1, plus 1 per maritime and minus 1 per aircraft or rail keyword; with a maritime one, plus 1.5 per disaster keyword, and 2 if the first is category or list."""
    sea, land, bad = [*SHIP_WORDS, *NAMED_SHIPS], LAND_WORDS, DISASTER_WORDS
    basic = F.aggregate(keywords, F.lit(1.0), lambda acc, x: acc + F.when(x.isin(*sea), 1.0).when(x.isin(*land), -1.0).otherwise(0.0))
    hits = F.size(F.filter(keywords, lambda x: x.isin(*bad)))
    maritime = F.exists(keywords, lambda x: x.isin(*sea))
    bonus = F.when((hits > 0) & F.lower(F.try_element_at(keywords, F.lit(1))).isin("category", "list"), 2.0).otherwise(0.0)
    return F.when(maritime, basic + hits * 1.5 + bonus).otherwise(basic)


def country_penalty(keywords: Column, countries: list[str]) -> Column:
    """1 where a url's one or two keywords are the name of a country, else 0; names are compared in lower case."""
    name = F.lower(F.array_join(keywords, " "))
    return F.when((F.size(keywords).between(1, 2)) & name.isin(*[c.lower() for c in countries]), 1.0).otherwise(0.0)


def link_score(relevance: Column, parent_score: Column, wave: Column) -> Column:
    """Frontier score of a link: relevance, the parent's score and the depth, rounded to 2 as decimals are."""
    return F.round((0.4 * relevance + 0.3 * parent_score + 0.35 / wave).cast("decimal(18,6)"), 2).cast("double")


def inlink_bump(score: Column, n_inlinks: Column) -> Column:
    """Score after another inlink; nothing is added from ten inlinks on."""
    return F.when(n_inlinks < 10, F.round(score + 0.0125, 2)).otherwise(score)
