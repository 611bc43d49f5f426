"""One SQL statement per registered query."""

from siteweave import lexicons as L
from siteweave.checks import sql as Q
from siteweave.checks.sql import query
from siteweave.sources import tables  # noqa: F401  (the lexicon rows below mirror tables.lexicon)

STATEMENTS: dict[str, str] = {}


def add(name: str, needs: list[str], final: str, **extra: str) -> None:
    STATEMENTS[name] = query(needs, final, **extra)


def unnested(lists: str, alias: str) -> str:
    """A list column as rows with a position from 0."""
    return f"unnest({lists}) AS {alias}, unnest(range(len({lists}))) AS pos"


LABELLED = "pos IN (SELECT doc_id FROM labels)"
EARLIER = (
    "SELECT url, name, page_type, CASE WHEN quality = 1 THEN 'done' ELSE 'failed' END AS status, "
    "make_timestamp((1700000000 + pos) * 1000000) AS updated_at FROM listing JOIN labels ON doc_id = pos"
)
LOWERED = "lower(full_description)"
SEEN = f"SELECT page_id, url, {Q.visible('html')} AS seen FROM pages"
MARKED = f"SELECT *, {Q.marked('full_description')} AS m FROM sites"
ADVICE = "SELECT site_key, name, tourism_type, place_type, location AS city FROM classed"
SITE_GLOSSARY = "SELECT site_key AS key, name, name || ' ' || full_description AS text FROM sites"
TITLED = (
    "SELECT s.site_key, s.name, s.unique_name, s.location, a.title, a.summary FROM sites s JOIN articles a "
    "ON a.lang = 'en' AND CAST(regexp_extract(a.title, '(\\d+)', 1) AS BIGINT) = s.site_key"
)


def rule_rows(rules) -> list[tuple[str, str]]:
    return [(w, out) for ws, out in rules for w in ws]


def lexicon_rows() -> list[tuple]:
    parts = {
        "region_alias": list(L.REGION_ALIASES.items()), "known_place": L.KNOWN_PLACES,
        "pronunciation": list(L.PRONUNCIATION.items()), "era_rule": rule_rows(L.ERA_RULES),
        "tourism_rule": rule_rows(L.TOURISM_RULES), "place_rule": rule_rows(L.PLACE_RULES),
        "era_rule_ext": rule_rows(L.ERA_RULES_EXT), "place_rule_ext": rule_rows(L.PLACE_RULES_EXT),
        "official_site": rule_rows(L.OFFICIAL_SITE_RULES), "city_tip": list(L.CITY_TIPS_EXT.items()),
        **{f"term_{c}": [(w, c) for w in ws] for c, ws in L.TERM_CATEGORIES},
    }
    return [(name, i, k, v) for name, rows in parts.items() for i, (k, v) in enumerate(rows)]


# ---- scans, sources, sinks ------------------------------------------------------------------------------
add("listing_scan", ["listing"], "SELECT * FROM listing WHERE page_type IN ('museums', 'monuments')")
add(
    "listing_card_extract", ["listing"],
    "SELECT url, name, location, trim(regexp_replace(description, '\\s+', ' ', 'g')) AS description, image, page_type FROM listing",
)
STATEMENTS["listing_card_extract"] = query(
    ["listing_pages"],
    f"SELECT {Q.attribute('tag', 'href')} AS url, {Q.attribute('tag', 'title')} AS name, "
    + Q.inner_text("regexp_extract(body, '(?is)class\\s*=\\s*\"(?:[^\"]*\\s)?location(?:\\s[^\"]*)?\"[^>]*>.*?<p(?:\\s[^>]*)?>(.*?)</p\\s*>', 1)")
    + " AS location, "
    + Q.inner_text("regexp_extract(body, '(?is)class\\s*=\\s*\"(?:[^\"]*\\s)?details(?:\\s[^\"]*)?\"[^>]*>\\s*<p(?:\\s[^>]*)?>(.*?)</p\\s*>', 1)")
    + f" AS description, {Q.attribute('img', 'src')} AS image, page_type FROM opened WHERE {Q.attribute('tag', 'href')} <> ''",
    pieces="SELECT page_type, unnest(regexp_split_to_array(html, '(?i)<a\\s')[2:]) AS piece FROM listing_pages",
    opened="SELECT page_type, ' ' || regexp_extract(piece, '(?s)^([^>]*)>', 1) AS tag, body, regexp_extract(body, '(?is)<img\\b([^>]*)>', 1) AS img FROM ("
    "SELECT page_type, piece, regexp_replace(piece, '(?is)^[^>]*>|</a\\s*>.*$', '', 'g') AS body FROM pieces "
    "WHERE regexp_matches(piece, '(?is)^[^>]*\\bclass\\s*=\\s*\"(?:[^\"]*\\s)?listItem(?:\\s[^\"]*)?\"'))",
)
add("page_scan", ["detail_pages"], "SELECT url, length(html) AS html_chars FROM detail_pages")
add("article_scan", ["articles"], "SELECT lang, title, summary, text, url, ar_link FROM articles")
add("gazetteer_scan", ["gazetteer"], "SELECT query, rank::BIGINT AS rank, lat, lon, state, province FROM gazetteer")
add("existing_output_scan", ["sites"], f"SELECT DISTINCT name FROM sites WHERE {LABELLED} AND name <> ''")
add("checkpoint_scan", ["listing"], "SELECT url, name, page_type, status FROM earlier", earlier=EARLIER)
add("checkpoint_sink", ["listing"], "SELECT page_type, status, count(*) AS sites FROM earlier GROUP BY ALL", earlier=EARLIER)
add("checkpoint_reset", ["listing"], "SELECT count(*) AS rows_before, 0::BIGINT AS rows_after FROM earlier", earlier=EARLIER)
add(
    "lexicon_scan", ["sites"],
    "SELECT lexicon, pos::BIGINT AS pos, l.key, value, coalesce(sites, 0) AS sites FROM lex l LEFT JOIN (SELECT lower(location) AS key, count(*) AS sites FROM sites GROUP BY 1) n ON n.key = l.key",
    lex=Q._values(lexicon_rows(), "lexicon, pos, key, value"),
)

# ---- page content ---------------------------------------------------------------------------------------
add("page_title", [], f"SELECT page_id, {Q.heading('seen', Q.q(''))} AS title FROM seen_pages", seen_pages=SEEN)
PARAS = f"SELECT page_id, {Q.paragraphs('seen')} AS paras FROM seen_pages"
add(
    "paragraph_extract", [], f"SELECT page_id, {Q.joined(Q.content('paras'), chr(10) + chr(10))} AS full_description FROM paras",
    seen_pages=SEEN, paras=PARAS,
)
add(
    "boilerplate_filter_ext", [],
    "SELECT page_id, "
    + Q.joined(
        Q.content("paras", L.FOOTER_PHRASES_EXT + L.NAVIGATION_PHRASES_EXT, max(L.MIN_PARAGRAPH, L.MIN_SENTENCE_EXT)), chr(10) + chr(10)
    )
    + " AS full_description FROM paras",
    seen_pages=SEEN, paras=PARAS,
)
add("script_detect", ["page_texts"], "SELECT url, arabic_heading AS arabic_name FROM page_texts")
add(
    "image_select", ["listing", "page_texts"],
    f"SELECT url, {Q.joined(Q.distinct('i') + '[1:5]')} AS images FROM (SELECT url, [image] || gallery AS i FROM listing JOIN page_texts USING (url))",
)
add("short_description", ["listing"], "SELECT url, left(description, 200) AS short_description FROM listing")
add("page_type_filter", ["listing"], "SELECT url AS href, name AS title FROM listing WHERE contains(url, '/museums/')")
add(
    "page_type_label", ["listing"],
    f"SELECT page_type, coalesce({Q.lookup(L.PAGE_TYPE_LABELS, 'page_type')}, {Q.title(chr(34) + 'spaced' + chr(34))}) AS label, sites FROM "
    "(SELECT page_type, replace(page_type, '-', ' ') AS spaced, count(*) AS sites FROM (SELECT page_type FROM listing UNION ALL "
    "SELECT source || '-' || lang || '-pages' FROM documents) GROUP BY ALL)",
)
add("url_language_swap", [], "SELECT page_id, url, replace(url, '/en/', '/ar/') AS arabic_url FROM pages")
ENCODED = "replace(url_encode({}), '%2F', '/')"
add(
    "query_urls", ["sites"],
    f"SELECT site_key, '{L.BASE_URL}/en/' || page_type || '/' AS listing_url, '{L.GEOCODER_URL}?q=' || "
    + ENCODED.format(f"unique_name || ', ' || location || ', {L.COUNTRY}'")
    + f" || '&format=json&addressdetails=1&limit=1' AS geocode_url, '{L.MAPS_SEARCH_URL}' || "
    + ENCODED.format(f"unique_name || ' {L.COUNTRY}'")
    + " AS maps_url FROM sites",
)
HOSTS = [*L.OFFICIAL_DOMAINS, "www.egypt.travel", "notegypt.travel", "egypt.travel.example"]
HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"
add(
    "official_domain_filter", [],
    f"SELECT url, {HOST} IN ({', '.join(Q.q(d) for d in L.OFFICIAL_DOMAINS)}) OR "
    + " OR ".join(f"{HOST} LIKE {Q.q('%.' + d)}" for d in L.OFFICIAL_DOMAINS)
    + f" AS is_official FROM (SELECT 'https://' || ({Q.texts(HOSTS)})[doc_id % 8 + 1] || '/' || doc_id AS url FROM documents UNION ALL SELECT url FROM pages)",
)
add("geo_bounds_filter", ["site_points"], "SELECT * FROM (SELECT site_key, lat * 1.125::DOUBLE AS lat, lon FROM site_points) WHERE lat BETWEEN 21 AND 32 AND lon BETWEEN 24 AND 37")

# ---- rule classifiers -----------------------------------------------------------------------------------
add("era_classify", ["classed"], "SELECT site_key, era FROM classed")
add("tourism_classify", ["classed"], "SELECT site_key, tourism_type FROM classed")
add("place_classify", ["classed"], "SELECT site_key, place_type FROM classed")
add("class_counts", ["classed"], "SELECT page_type, era, tourism_type, place_type, count(*) AS sites FROM classed GROUP BY ALL")
add(
    "keyword_classify_ext", ["sites"],
    f"SELECT site_key, {Q.cascade(LOWERED, L.ERA_RULES_EXT, Q.q(''))} AS era, {Q.place('name', LOWERED, L.PLACE_RULES_EXT)} AS place_type FROM sites",
)
add(
    "class_domain_check", ["classed"],
    " UNION ALL ".join(
        f"SELECT '{field}' AS field, {field} AS value, count(*) AS sites FROM classed WHERE {field} NOT IN ({', '.join(Q.q(v) for v in domain)}) GROUP BY ALL"
        for field, domain in (("era", L.ERA_DOMAIN), ("tourism_type", L.TOURISM_DOMAIN), ("place_type", L.PLACE_DOMAIN))
    ),
)
add("relevance_flag", ["sites", "articles"], f"SELECT site_key, title, {Q.relevant('name', 'title', 'summary')} AS relevant FROM titled", titled=TITLED)
PRICES = [f"nullif(regexp_extract(full_description, {Q.q('(?i)' + p)}, 1), '')" for p in L.PRICE_PATTERNS]
add(
    "price_mention", ["sites"],
    f"SELECT site_key, CASE WHEN coalesce({', '.join(PRICES)}) IS NOT NULL THEN '{L.PRICE_SOURCE}' ELSE '' END AS source_url, "
    f"try_cast(coalesce({', '.join(PRICES)}) AS BIGINT) AS amount FROM sites",
)
MAPS = ["map_captures"]
add("hours_text_flag", MAPS, f"SELECT doc_id, {Q.any_contains('lower(hours_text)', L.HOURS_MARKS)} AS has_hours FROM map_captures")

# ---- text scalars ---------------------------------------------------------------------------------------
add("clean_text", ["sites"], f"SELECT site_key, {Q.clean('full_description')} AS clean FROM sites")
add("sentence_split", ["sites"], f"SELECT site_key, {unnested('parts', 'sentence')} FROM (SELECT site_key, {Q.sentences('full_description')} AS parts FROM sites)")
TOLD = f"list_transform(list_filter({Q.sentences('full_description')}, lambda fs: length(fs) BETWEEN 30 AND 300 AND {Q.fact_test('fs')}), lambda fc: {Q.clean('fc')})"
FIGURES = f"{Q.find_words('m', L.ARTICLE_PHARAOHS, L.ARTICLE_NUMERAL)} || {Q.find_words('m', L.ARTICLE_DEITIES)}"
add("fact_extract", ["sites"], f"SELECT site_key, {Q.joined(Q.distinct('told') + '[1:5]')} AS facts FROM (SELECT site_key, {TOLD} AS told FROM sites)")
add("key_figure_extract", ["sites"], f"SELECT site_key, {Q.joined(Q.distinct('f') + '[1:10]')} AS figures FROM (SELECT site_key, {FIGURES} AS f FROM ms)", ms=MARKED)
add(
    "feature_extract", ["sites"],
    f"SELECT site_key, {Q.joined(Q.distinct('f'))} AS features FROM (SELECT site_key, list_transform({Q.find_words('m', L.ARTICLE_FEATURES)}, lambda ft: {Q.title('ft')}) AS f FROM ms)",
    ms=MARKED,
)
add(
    "period_extract", ["sites"],
    f"SELECT site_key, coalesce(({Q.find_words(Q.marked('left(full_description, 2000)'), L.ARTICLE_PERIODS)})[1], '') AS period FROM sites",
)


def site_terms(final: str, needs: list[str] = (), **extra: str) -> str:
    """Terms of the described sites (the library's ``terms`` table reads the researched ones)."""
    return query(["sites", *needs], final, glossary_in=SITE_GLOSSARY, terms=Q._terms_cte(), **extra)


STATEMENTS["term_extract"] = site_terms(f"SELECT key AS site_key, pos, t.term AS term, t.category AS category FROM (SELECT key, {unnested('terms', 't')} FROM terms)")
add("search_variants", ["listing"], f"SELECT url, {Q.joined(Q.variants('name', 'location'))} AS variants FROM listing")
add(
    "phonetic_guide", ["sites"],
    f"SELECT word, {Q.phonetic('word')} AS guide, uses FROM (SELECT word, count(*) AS uses FROM (SELECT unnest(regexp_split_to_array(full_description, '\\s+')) AS word FROM sites) GROUP BY word)",
)
add("title_case", ["listing"], f"SELECT url, {Q.title('description')} AS titled FROM listing")
SITE_SUBS = f"{Q.distinct('every')}[1:5]"
add(
    "sub_location_extract", ["sites"],
    "SELECT s.* FROM (SELECT unnest(CASE WHEN len(found) > 0 THEN list_transform(found, lambda sf, si: {'id': sid || '_sub_' || lpad(si::VARCHAR, 2, '0'), "
    "'siteId': sid, 'name': sf, 'arabicName': '', 'shortDescription': 'Notable feature of ' || name, 'imageName': '', 'fullDescription': ''}) ELSE "
    "[{'id': sid || '_sub_01', 'siteId': sid, 'name': name, 'arabicName': '', 'shortDescription': left(full_description, 200), 'imageName': '', 'fullDescription': full_description}] END) AS s FROM found)",
    found=f"SELECT *, {SITE_SUBS} AS found FROM (SELECT 'site_' || site_key AS sid, name, full_description, {Q.SUBS} AS every FROM sites)",
)
DAY = "CASE " + " ".join(f"WHEN contains(lower(line), '{d.lower()}') THEN '{d}'" for d in L.WEEKDAYS) + " END"
RANGE = "(?i)" + L.TIME_RANGE


def time_range(x: str) -> str:
    start, end = (f"regexp_extract({x}, {Q.q(RANGE)}, {i})" for i in (1, 2))
    return f"CASE WHEN {start} <> '' THEN {start} || ' - ' || {end} ELSE '' END"


DAYS = (
    "SELECT doc_id, day, arg_max(hours, pos) AS hours FROM (SELECT doc_id, pos, "
    f"{DAY} AS day, coalesce(nullif({time_range('line')}, ''), CASE WHEN contains(lower(line), 'closed') THEN 'Closed' END) AS hours FROM ("
    f"SELECT doc_id, {unnested('lines', 'line')} FROM (SELECT doc_id, string_split(hours_text, chr(10)) AS lines FROM map_captures))) "
    "WHERE day IS NOT NULL AND hours IS NOT NULL GROUP BY ALL"
)
add("hours_parse", MAPS, DAYS)
add("hours_simple", MAPS, f"SELECT doc_id, {time_range('hours_text')} AS hours FROM map_captures")


def coord(i: int) -> str:
    return f"try_cast(nullif(regexp_extract(map_url, {Q.q(L.MAP_COORDS)}, {i}), '') AS DOUBLE)"


RATING = f"try_cast(nullif(regexp_extract(rating_text, {Q.q(L.RATING_NUMBER)}, 1), '') AS DOUBLE)"
RATED = f"CASE WHEN {RATING} BETWEEN 0 AND 5 THEN {RATING} END"
REVIEWS = f"try_cast(nullif(replace(regexp_extract(review_text, {Q.q('(?i)' + L.REVIEW_COUNT)}, 1), ',', ''), '') AS BIGINT)"
add("coords_from_url", MAPS, f"SELECT doc_id, {coord(1)} AS lat, {coord(2)} AS lon FROM map_captures")
add("rating_parse", MAPS, f"SELECT doc_id, {RATED} AS rating FROM map_captures")
add("review_count_parse", MAPS, f"SELECT doc_id, {REVIEWS} AS reviews FROM map_captures")
add("coords_parse", ["gazetteer"], "SELECT query, try_cast(lat AS DOUBLE) AS lat, try_cast(lon AS DOUBLE) AS lon FROM gazetteer")
add("address_region", ["gazetteer"], f"SELECT query, {Q.address('state', 'province')} AS region FROM gazetteer")

# ---- joins and lookups ----------------------------------------------------------------------------------
add("listing_detail_join", ["listing", "detail_pages"], "SELECT url, name, pos, length(html) AS html_chars FROM listing JOIN detail_pages USING (url)")
add(
    "language_pair_join", ["listing", "page_texts"],
    "SELECT l.url, l.name, coalesce(p.arabic_heading, '') AS arabic_name FROM listing l LEFT JOIN page_texts p ON p.url = replace(l.url, '/en/', '/ar/')",
)
add("exact_variant_match", ["exact"], "SELECT name, location, title, variant_pos FROM exact")
add("fuzzy_match", ["fuzzy_all"], "SELECT name, location, title, query_pos, rank FROM fuzzy_all")
add("langlink_join", ["twins"], "SELECT title, arabic_title, arabic_summary, arabic_url FROM twins")
STATEMENTS["translate_lookup"] = site_terms(
    "SELECT a.term, coalesce(d.arabic, '') AS arabic FROM (SELECT DISTINCT t.term AS term FROM (SELECT unnest(terms) AS t FROM terms) UNION SELECT name FROM listing) a "
    "LEFT JOIN dictionary d ON d.term = lower(trim(a.term))", ["dictionary", "listing"],
)
add(
    "translate_terms", ["listing", "dictionary"],
    f"SELECT pos, name AS english, coalesce(arabic, '') AS arabic, {Q.pronounce('name')} AS pronunciation FROM listing LEFT JOIN dictionary ON term = lower(trim(name))",
)
STATEMENTS["pronounce_lookup"] = site_terms(
    f"SELECT term, {Q.pronounce('term')} AS pronunciation FROM (SELECT DISTINCT t.term AS term FROM (SELECT unnest(terms) AS t FROM terms))"
)
add("known_place_match", ["sites"], f"SELECT site_key, {Q.known_place('unique_name')} AS region FROM sites")
add("alias_lookup", ["sites"], f"SELECT site_key, {Q.alias('location')} AS region FROM sites")
add("forward_geocode", ["forward"], "SELECT name, location, region FROM forward")
add("reverse_geocode", ["site_points", "nearest_of_any"], "SELECT site_key, place, region, round(distance_km, 6) AS distance_km FROM site_points LEFT JOIN nearest_of_any USING (lat, lon) WHERE lat IS NOT NULL AND lon IS NOT NULL")
add(
    "region_cascade", ["listing", "forward", "nearest", "saved_reverse", "site_points"],
    f"SELECT pos AS site_key, l.name, coalesce({Q.known_place('l.name')}, {Q.alias('l.location')}, f.region, sr.region, n.region, l.location) AS region FROM listing l "
    "JOIN site_points p ON p.site_key = l.pos LEFT JOIN forward f ON f.name = l.name AND f.location = l.location LEFT JOIN nearest n ON n.lat = p.lat AND n.lon = p.lon LEFT JOIN saved_reverse sr ON sr.lat = p.lat AND sr.lon = p.lon",
)
add("coordinates_lookup", ["listing", "coords"], f"SELECT name AS heading, url, latitude, longitude FROM listing LEFT JOIN coords ON query = name || ', {L.COUNTRY}'")
FLAT = (
    'id, name, "arabicName", era, "tourismType", "placeType", governorate, latitude, longitude, "shortDescription", "fullDescription", "estimatedDuration", '
    f'"bestTimeToVisit", "openingHours", "officialWebsite", "wikipediaUrl", {Q.joined(chr(34) + "imageNames" + chr(34))} AS "imageNames", {Q.joined("facts")} AS "uniqueFacts", '
    f'{Q.joined("figures")} AS "keyFigures", {Q.joined("features")} AS "architecturalFeatures", {Q.joined("tips")} AS tips, '
    f'{Q.joined("list_transform(subs, lambda fs: fs.name)")} AS "subLocations", {Q.joined("list_transform(entries, lambda fe: fe.english)")} AS "arabicPhrases"'
)
add(
    "site_synthesize", ["site"],
    f'SELECT id, name, era, "tourismType", "placeType", governorate, "wikipediaUrl", {Q.joined("list_transform(subs, lambda fs: fs.name)")} AS "subLocations", {Q.joined("tips")} AS tips FROM site',
)
NARROW = "url, name, page_type, pos"
add(
    "skip_processed", ["listing"],
    f"SELECT {NARROW} FROM listing WHERE url NOT IN (SELECT url FROM earlier) AND name NOT IN (SELECT name FROM earlier)", earlier=EARLIER,
)
add("skip_existing", ["listing"], f"SELECT {NARROW} FROM listing WHERE name NOT IN (SELECT name FROM listing WHERE {LABELLED})")
add(
    "skip_completed_types", ["listing"],
    f"SELECT {NARROW} FROM listing WHERE page_type NOT IN (SELECT page_type FROM listing WHERE {LABELLED} GROUP BY page_type ORDER BY count(*) DESC, page_type LIMIT 1)",
)
MARKS = (
    f"SELECT page_type, row_number() OVER (PARTITION BY page_type ORDER BY pos) AS number, pos, url, name, location, name IN (SELECT name FROM listing WHERE {LABELLED}) AS exists_already FROM listing"
)
STATUS = "CASE WHEN exists_already THEN 'Already exists' ELSE 'New' END AS status"
add("dry_run_status", ["listing"], f"SELECT page_type, number, url, name, location, exists_already, {STATUS} FROM marks", marks=MARKS)
add("region_validate", ["sites"], f"SELECT site_key, location, location IN ({', '.join(Q.q(r) for r in L.REGION_NAMES)}) AS valid FROM sites")
add("official_site_lookup", ["sites"], f"SELECT site_key, {Q.official_site('unique_name')} AS official_website FROM sites")

# ---- aggregations ---------------------------------------------------------------------------------------
add("count_by_type", ["listing"], "SELECT coalesce(page_type, 'ALL') AS page_type, count(*) AS sites FROM listing GROUP BY ROLLUP (page_type)")
add(
    "new_vs_existing", ["listing"],
    "SELECT count(*) AS total, count(*) FILTER (NOT exists_already) AS new_sites, count(*) FILTER (exists_already) AS existing_sites, "
    f"(SELECT count(*) FROM listing WHERE {LABELLED}) AS existing_names, count(*) - (SELECT count(*) FROM listing WHERE {LABELLED}) AS new_by_difference FROM marks",
    marks=MARKS,
)


def na(c: str) -> str:
    return f"coalesce(nullif({c}, ''), 'N/A')"


add(
    "site_summary", ["site"],
    f'SELECT id, name, {na("governorate")} AS region, {na("era")} AS era, "tourismType" || \' / \' || "placeType" AS type, len(facts) AS facts, len(tips) AS tips, len(entries) AS phrases FROM site',
)
COUNTS = {
    "sites": "count(*)", "subLocations": "sum(len(subs))::BIGINT", "cards": "sum(len(subs))::BIGINT", "tips": "sum(len(tips))::BIGINT",
    "arabicPhrases": "sum(len(entries))::BIGINT",
}
TABLE_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, {c} AS rows FROM site" for t, c in COUNTS.items())
add("export_counts", ["site"], TABLE_COUNTS)
ARABIC = "(\"arabicName\" <> '' OR len(entries) > 0)"
add(
    "coverage_metrics", ["site"],
    "SELECT coalesce(page_type, 'ALL') AS page_type, count(*) AS sites, "
    f"round(avg((era <> '' AND governorate <> '' AND \"fullDescription\" <> '' AND latitude IS NOT NULL AND {ARABIC})::INT::DOUBLE), 6) AS complete, "
    f"round(avg({ARABIC}::INT::DOUBLE), 6) AS arabic, round(avg((len(facts) > 0)::INT::DOUBLE), 6) AS facts, "
    "round(avg((\"wikipediaUrl\" <> '')::INT::DOUBLE), 6) AS matched FROM site GROUP BY ROLLUP (page_type)",
)
add(
    "checkpoint_stats", ["listing"],
    "SELECT count(DISTINCT url) AS total_processed, count(DISTINCT page_type) AS page_types_completed, max(updated_at) AS last_updated FROM earlier", earlier=EARLIER,
)
add("region_list", ["sites"], f"SELECT DISTINCT {Q.alias('location')} AS region FROM sites WHERE {Q.alias('location')} IS NOT NULL ORDER BY 1")
add(
    "distinct_entities", ["sites"],
    f"SELECT entity, count(*) AS sites FROM (SELECT unnest({Q.distinct('f')}[1:10]) AS entity FROM (SELECT {FIGURES} AS f FROM ms)) GROUP BY entity", ms=MARKED,
)
add("token_overlap", ["sites", "articles"], f"SELECT site_key, title, {Q.overlap('unique_name', 'title')} AS overlap FROM titled", titled=TITLED)

# ---- ranking, top-k, numbering --------------------------------------------------------------------------
add("top_n_per_type", ["listing"], "SELECT page_type, pos, url, name FROM (SELECT *, row_number() OVER (PARTITION BY page_type ORDER BY pos) AS n FROM listing) WHERE n <= 30")
TYPE_ORDER = f"list_position({Q.texts(L.PAGE_TYPES)}, page_type), pos"
SITE_ID = "'site_' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') AS id"
add(
    "site_numbering", ["listing", "detail_pages"],
    f"SELECT {SITE_ID}, url FROM (SELECT url, row_number() OVER (ORDER BY {TYPE_ORDER}) AS n FROM listing WHERE url IN (SELECT url FROM detail_pages))",
)
add(
    "child_numbering", ["sites"],
    f"SELECT site_key, pos + 1 AS number, sub_name FROM (SELECT site_key, {unnested('found', 'sub_name')} FROM (SELECT site_key, {SITE_SUBS} AS found FROM (SELECT site_key, {Q.SUBS} AS every FROM sites)))",
)
STATEMENTS["glossary_topk"] = site_terms(f"SELECT key AS site_key, {Q.joined('list_transform(terms[1:8], lambda gt: gt.term)')} AS terms FROM terms")
add(
    "first_k_facts", ["sites"],
    f"SELECT site_key, len({Q.distinct('told')}[1:3]) AS facts, len({Q.distinct('f')}[1:2]) AS figures, len({Q.distinct('every')}[1:1]) AS subs FROM "
    f"(SELECT site_key, {TOLD} AS told, {FIGURES} AS f, {Q.SUBS} AS every FROM ms)", ms=MARKED,
)
add("search_top5", ["hits"], "SELECT array_to_string(word_set, ' ') AS words, rank, title, overlap FROM hits")
add("first_match_wins", ["matched"], "SELECT name, location, title, how FROM matched")
add(
    "listing_row_number", ["listing"],
    "SELECT page_type, name, row_number() OVER (PARTITION BY page_type ORDER BY pos) AS i, count(*) OVER (PARTITION BY page_type) AS of_n FROM listing",
)

# ---- set operations -------------------------------------------------------------------------------------
add("union_page_types", ["listing"], "SELECT page_type, pos, url, name FROM listing")
add(
    "union_entities", ["sites"],
    f"SELECT site_key, {Q.joined(Q.distinct('f'))} AS entities FROM (SELECT site_key, {Q.find_words('m', L.ARTICLE_PHARAOHS, L.ARTICLE_NUMERAL)} || {Q.find_words('m', L.ARTICLE_FEATURES)} AS f FROM ms)",
    ms=MARKED,
)
add("checkpoint_merge", ["sites"], "SELECT DISTINCT name FROM sites WHERE name <> ''")
add("pending_sites", ["listing"], f"SELECT {NARROW} FROM listing WHERE url NOT IN (SELECT url FROM earlier WHERE status = 'done')", earlier=EARLIER)

# ---- normalise ------------------------------------------------------------------------------------------
SUB_ROWS = "SELECT id AS site_id, \"fullDescription\", unnest(subs) AS s FROM site"
add(
    "explode_sub_locations", ["site"],
    "SELECT s.id AS id, site_id AS \"siteId\", s.name AS name, '' AS \"arabicName\", s.short AS \"shortDescription\", '' AS \"imageName\" FROM sub_rows", sub_rows=SUB_ROWS,
)
add(
    "derive_cards", ["site"],
    "SELECT s.id || '_card_01' AS id, s.id AS \"subLocationId\", coalesce(nullif(s.full, ''), \"fullDescription\") AS \"fullDescription\" FROM sub_rows", sub_rows=SUB_ROWS,
)
add("explode_tips", ["site"], f'SELECT id AS "siteId", {unnested("tips", "tip")} FROM site')
add(
    "explode_phrases", ["site"],
    f'SELECT "siteId", pos, p.english AS english, p.arabic AS arabic, p.pronunciation AS pronunciation FROM (SELECT id AS "siteId", {unnested("entries", "p")} FROM site)',
)
add(
    "project_sites", ["site"],
    'SELECT id, name, "arabicName", era, "tourismType", "placeType", governorate, latitude, longitude, "shortDescription", "estimatedDuration", "bestTimeToVisit", "openingHours", '
    f'"officialWebsite", "wikipediaUrl", {Q.joined(chr(34) + "imageNames" + chr(34))} AS "imageNames", {Q.joined("facts")} AS "uniqueFacts", {Q.joined("figures")} AS "keyFigures", '
    f'{Q.joined("features")} AS "architecturalFeatures" FROM site',
)
CONTEXT = Q.context_tips("name", "place_type", "tourism_type", "city")
add("nest_children", ["classed"], f"SELECT site_key, {Q.joined(CONTEXT)} AS tips FROM advice", advice=ADVICE)

# ---- advice ---------------------------------------------------------------------------------------------
add("contextual_tips", ["classed"], f"SELECT site_key, {Q.joined(CONTEXT)} AS tips FROM advice", advice=ADVICE)
add("visit_duration", ["classed"], f"SELECT site_key, {Q.duration('name', 'place_type')} AS duration FROM advice", advice=ADVICE)
add("best_time", ["classed"], f"SELECT site_key, {Q.best_time('place_type', 'city')} AS best_time FROM advice", advice=ADVICE)
add("site_tips", ["classed"], f"SELECT site_key, {Q.joined(Q.all_tips('name', 'place_type', 'tourism_type', 'city'))} AS tips FROM advice", advice=ADVICE)
add("city_tip_ext", ["sites"], f"SELECT site_key, coalesce({Q.lookup(L.CITY_TIPS_EXT, 'location')}, '') AS tip FROM sites")
BOOK = [(place, i, *p) for place, phrases in L.PHRASE_BOOK_EXT.items() for i, p in enumerate(phrases)]
add(
    "phrase_book_ext", ["classed"], "SELECT site_key, book.pos::BIGINT AS pos, english, arabic, pronunciation FROM classed JOIN book USING (place_type)",
    book=Q._values(BOOK, "place_type, pos, english, arabic, pronunciation"),
)

# ---- whole runs -----------------------------------------------------------------------------------------
add(
    "page_facts", ["page_facts"],
    f"SELECT url, name, heading, full_description, arabic_name, era, tourism_type, place_type, latitude, longitude, location, {Q.joined('images')} AS images FROM page_facts",
)
add(
    "article_facts", ["matched", "article_facts"],
    "SELECT name, title, summary, article_url, arabic_title, arabic_summary, arabic_url, historical_period, "
    f"{Q.joined('unique_facts')} AS unique_facts, {Q.joined('key_figures')} AS key_figures, {Q.joined('architectural_features')} AS architectural_features "
    "FROM matched JOIN article_facts USING (title)",
)
STATEMENTS["glossary"] = query(
    ["listing", "dictionary"],
    f"SELECT key AS url, pos, e.english AS english, e.arabic AS arabic, e.pronunciation AS pronunciation, e.context AS context FROM (SELECT key, {unnested('entries', 'e')} FROM glossary)",
    glossary_in="SELECT url AS key, name, name || ' ' || description AS text FROM listing",
    terms=Q._terms_cte(),
    known="SELECT url AS id, coalesce(arabic, '') AS name_arabic FROM listing LEFT JOIN dictionary ON term = lower(trim(name))",
    glossary=Q.CTES["glossary"][1],
)
TOLD_HOURS = Q.any_contains("lower(hours_text)", L.HOURS_MARKS)
add(
    "place_info", MAPS,
    f"SELECT doc_id, CASE WHEN {TOLD_HOURS} THEN hours_text ELSE '' END AS opening_hours_text, CASE WHEN {TOLD_HOURS} THEN {time_range('hours_text')} ELSE '' END AS opening_hours_simple, "
    f"CASE WHEN {TOLD_HOURS} THEN coalesce(week, '') ELSE '' END AS opening_hours, {coord(1)} AS latitude, {coord(2)} AS longitude, {RATED} AS rating, {REVIEWS} AS review_count FROM map_captures LEFT JOIN "
    f"(SELECT doc_id, string_agg(day || '=' || hours, ' | ' ORDER BY list_position({Q.texts(L.WEEKDAYS)}, day)) AS week FROM days GROUP BY doc_id) USING (doc_id)",
    days=DAYS,
)
add("research_sites", ["site"], f"SELECT {FLAT} FROM site")
LIMITED = {
    "listing": "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY page_type ORDER BY pos) AS n FROM all_listing) WHERE n <= 25 AND page_type IN ('museums', 'monuments')",
}


def limited_run() -> str:
    """The research statement with its listing cut to the first 25 of two page types."""
    order = Q._order(["site"], [])
    at = order.index("listing")
    parts = []
    for i, name in enumerate(order):
        body = Q.CTES[name][1]
        if i == at:
            parts.append(f"all_listing AS ({body})")
            body = LIMITED["listing"]
        if name == "known":  # ids follow the order in which the run names its types
            body = body.replace(f"list_position({Q.texts(L.PAGE_TYPES)}, page_type)", "CASE page_type WHEN 'museums' THEN 1 WHEN 'monuments' THEN 2 END")
        parts.append(f"{name} AS ({body})")
    return f"WITH {', '.join(parts)} SELECT {FLAT} FROM site"


STATEMENTS["research_all"] = limited_run()
add("export_json", ["site"], TABLE_COUNTS)
KEYED = {"sites": "1", "subLocations": "len(subs)", "cards": "len(subs)", "tips": "len(tips)", "arabicPhrases": "len(entries)"}
add(
    "export_all", ["site"],
    "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT id AS site, sum({n})::BIGINT AS rows, '{t}' AS table_name FROM site GROUP BY 1" for t, n in KEYED.items())
    + ") WHERE rows > 0",
)
add(
    "checkpoint_document", ["listing"],
    "SELECT DISTINCT 'url' AS kind, url AS value FROM listing WHERE (pos // 100) % 4 <> 2 UNION ALL "
    "SELECT DISTINCT 'name', name FROM listing WHERE (pos // 100) % 4 = 0 UNION ALL "
    "SELECT DISTINCT 'type', page_type FROM listing WHERE (pos // 100) % 4 IN (0, 3) UNION ALL "
    "SELECT DISTINCT 'malformed', (pos // 100)::VARCHAR FROM listing WHERE (pos // 100) % 4 IN (2, 3)",
)
STATEMENTS["export_document"] = STATEMENTS["export_all"]
add(
    "dry_run", ["listing"], f"SELECT page_type, {STATUS}, count(*) AS sites FROM marks WHERE number <= 20 GROUP BY ALL", marks=MARKS,
)
add(
    "incremental_run", ["listing", "detail_pages"],
    "SELECT url, name, page_type, CASE WHEN url IN (SELECT url FROM detail_pages) THEN 'done' ELSE 'failed' END AS status FROM listing",
)

# ---- streams --------------------------------------------------------------------------------------------
add("incremental_listing", ["listing"], "SELECT * FROM listing")
add("stream_dedup", ["listing"], "SELECT DISTINCT page_type, url FROM listing")
add("incremental_updates", [], "SELECT page_id, url FROM pages WHERE page_id IN (SELECT doc_id FROM labels)")
