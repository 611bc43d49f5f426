"""Ordered rules: the first one that holds gives the class."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteweave import lexicons as L
from siteweave.functions import text as T

Rules = list[tuple[list[str], str]]


def cascade(branches: list[tuple[Column, Column]], default: Column) -> Column:
    """CASE WHEN over (condition, value) pairs; evaluation stops at the first that holds."""
    first, *rest = branches
    chain = reduce(lambda c, b: c.when(b[0], b[1]), rest, F.when(first[0], first[1]))
    return chain.otherwise(default)


def by_keyword(lowered: Column, rules: Rules, default: str = "") -> Column:
    """Classify lower-cased text by the substrings it contains."""
    return cascade([(T.any_contains(lowered, words), F.lit(out)) for words, out in rules], F.lit(default))


def by_value(c: Column, rules: Rules, default: Column) -> Column:
    """Classify a value by exact membership."""
    return cascade([(c.isin(values), F.lit(out)) for values, out in rules], default)


def era(lowered: Column, rules: Rules = L.ERA_RULES) -> Column:
    return by_keyword(lowered, rules)


def tourism_type(era_name: Column, lowered: Column, name: Column) -> Column:
    """By era where it decides, else by keywords of description and name."""
    combined = F.concat_ws(" ", lowered, F.lower(name))
    return by_value(era_name, L.TOURISM_BY_ERA, by_keyword(combined, L.TOURISM_RULES, L.TOURISM_DEFAULT))


def place_type(name: Column, lowered: Column, rules: Rules = L.PLACE_RULES) -> Column:
    """First place keyword in name and description."""
    return by_keyword(F.concat_ws(" ", F.lower(name), lowered), rules, L.PLACE_DEFAULT)


def known_place_region(name: Column) -> Column:
    """Region of the first known place that is part of the name, else null."""
    lowered = F.lower(name)
    return cascade(
        [(F.contains(lowered, F.lit(place)), F.lit(region)) for place, region in L.KNOWN_PLACES],
        F.lit(None).cast("string"),
    )


def alias_region(hint: Column) -> Column:
    """Official region of an alias, else null."""
    return T.lookup(L.REGION_ALIASES, F.lower(T.strip(hint)))


def is_region(name: Column) -> Column:
    return name.isin(L.REGION_NAMES)


def in_bounds(lat: Column, lon: Column) -> Column:
    b = L.GEO_BOUNDS
    return lat.between(b["lat_min"], b["lat_max"]) & lon.between(b["lon_min"], b["lon_max"])


def official_website(name: Column) -> Column:
    return by_keyword(F.lower(name), L.OFFICIAL_SITE_RULES)


def is_official_domain(url: Column) -> Column:
    """Host equals a listed domain or is below one."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    hit = [(host == d) | F.endswith(host, F.lit("." + d)) for d in L.OFFICIAL_DOMAINS]
    return F.coalesce(reduce(lambda a, b: a | b, hit), F.lit(False))


def mentions_price(c: Column) -> Column:
    return F.rlike(c, F.lit("(?iU)" + "|".join(L.PRICE_PATTERNS)))


def price_amount(c: Column) -> Column:
    """Amount of the first pattern, in pattern order, that occurs; null if none does."""
    found = [F.nullif(T.first_match(c, "(?iU)" + p), F.lit("")) for p in L.PRICE_PATTERNS]
    return F.coalesce(*found).try_cast("int")


def mentions_hours(c: Column) -> Column:
    return T.let(F.lower(c), lambda lowered: T.any_contains(lowered, L.HOURS_MARKS))


def visit_duration(name: Column, place: Column) -> Column:
    typed = by_value(F.lower(place), L.DURATION_BY_TYPE, F.lit(L.DEFAULT_DURATION))
    return F.when(T.any_contains(F.lower(name), L.LARGE_COMPLEXES), F.lit(L.LARGE_DURATION)).otherwise(typed)


def best_time(place: Column, city: Column) -> Column:
    towns, advice = L.BEST_TIME_HOT
    by_town = F.when(F.lower(city).isin(towns), F.lit(advice)).otherwise(F.lit(L.DEFAULT_BEST_TIME))
    return by_value(F.lower(place), L.BEST_TIME_BY_TYPE, by_town)


def _texts(lines: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in lines])


def _none() -> Column:
    return F.array().cast("array<string>")


def contextual_tips(name: Column, place: Column, tourism: Column, city: Column) -> Column:
    """General advice, then one branch each by type, by city and by tourism type."""
    lowered, kind, town = F.lower(name), F.lower(place), F.lower(city)
    by_type = cascade(
        [
            ((kind == "pyramid") | F.contains(lowered, F.lit("pyramid")), _texts(L.PYRAMID_TIPS)),
            ((kind == "tomb") | T.any_contains(lowered, ["tomb", "valley"]), _texts(L.TOMB_TIPS)),
            (kind == "temple", _texts(L.TEMPLE_TIPS)),
            (kind == "museum", _texts(L.MUSEUM_TIPS)),
            (kind == "mosque", _texts(L.MOSQUE_TIPS)),
            (kind.isin("church", "monastery"), _texts(L.CHURCH_TIPS)),
        ],
        _none(),
    )
    by_city = cascade([(town.isin(v), _texts([tip])) for v, tip in L.CITY_RULES], _none())
    by_tourism = cascade(
        [(F.lower(tourism).isin(v), _texts([tip])) for v, tip in L.TOURISM_TIP_RULES], _none()
    )
    return F.slice(F.concat(_texts(L.GENERAL_TIPS), by_type, by_city, by_tourism), 1, L.MAX_CONTEXT_TIPS)


def ticket_tips(price: Column, booking_url: Column) -> Column:
    """Ticket lines for the facts that are known (non-empty)."""
    return F.filter(
        F.array(
            F.when(price != "", F.concat(F.lit("Ticket price (foreigners): "), price)),
            F.when(booking_url != "", F.concat(F.lit("Online tickets available at: "), booking_url)),
        ),
        lambda tip: tip.isNotNull(),
    )


def site_tips(
    name: Column,
    place: Column,
    tourism: Column,
    city: Column,
    price: Column | None = None,
    booking_url: Column | None = None,
) -> Column:
    """Contextual tips followed by the ticket, website, duration and best-time lines."""
    website = official_website(name)
    closing = F.filter(
        F.array(
            F.when(website != "", F.concat(F.lit("Official website: "), website)),
            F.concat(F.lit("Recommended visit duration: "), visit_duration(name, place)),
            F.concat(F.lit("Best time to visit: "), best_time(place, city)),
        ),
        lambda tip: tip.isNotNull(),
    )
    parts = [contextual_tips(name, place, tourism, city)]
    if price is not None or booking_url is not None:
        blank = F.lit("")
        parts.append(ticket_tips(blank if price is None else price, blank if booking_url is None else booking_url))
    return F.concat(*parts, closing)
