"""SQL building blocks: the same definitions once more, written for DuckDB.

Scalars are Python functions from SQL text to SQL text; tables are named CTEs that :func:`query` puts in front
of a final SELECT together with everything they need.  The regular-expression engine there knows ASCII word
boundaries only, so word searches run over text in which every non-word character sits between two marks.
"""

from siteweave import lexicons as L
from siteweave.functions import html as H
from siteweave.sources import corpus as C

NW = r"[^\p{L}\p{N}_]"          # a non-word character
NWL = r"[^\p{L}\p{N}_\n]"       # the same within one line


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def texts(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]::VARCHAR[]"


# ---- scalars --------------------------------------------------------------------------------------------
def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def clean(x: str) -> str:
    return collapse(f"regexp_replace({x}, '\\[\\d+\\]', '', 'g')")


def sentences(x: str) -> str:
    return f"string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2))"


def title(x: str) -> str:
    runs = f"regexp_extract_all(lower({x}), '(\\p{{L}}+|[^\\p{{L}}]+)', 1)"
    return f"array_to_string(list_transform({runs}, lambda tw: replace(upper(left(tw, 1)), 'ẞ', 'Ss') || substr(tw, 2)), '')"


def any_contains(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def marked(x: str) -> str:
    return f"(chr(1) || regexp_replace({x}, '({NW})', chr(1) || '\\1' || chr(1), 'g') || chr(1))"


def _marked_word(word: str) -> str:
    return "".join(c if c.isalnum() or c in "?" else rf"\x01{c}\x01" for c in word)


def marked_pattern(words: list[str], tail: str = "") -> str:
    return rf"\x01({'|'.join(_marked_word(w) for w in words)}){tail}\x01"


def find_words(marked_text: str, words: list[str], tail: str = "") -> str:
    found = f"regexp_extract_all({marked_text}, {q(marked_pattern(words, tail))}, 1, 'i')"
    return f"list_transform({found}, lambda fw: replace(fw, chr(1), ''))"


def distinct(x: str) -> str:
    """Distinct list elements in order of first occurrence; ``x`` should be a column."""
    return f"list_filter({x}, lambda de, di: list_position({x}, de) = di)"


def cascade(x: str, rules: list[tuple[list[str], str]], default: str) -> str:
    whens = " ".join(f"WHEN {any_contains(x, words)} THEN {q(out)}" for words, out in rules)
    return f"CASE {whens} ELSE {default} END"


def member(x: str, rules: list[tuple[list[str], str]], default: str) -> str:
    whens = " ".join(f"WHEN {x} IN ({', '.join(q(v) for v in values)}) THEN {q(out)}" for values, out in rules)
    return f"CASE {whens} ELSE {default} END"


def lookup(entries: dict[str, str], key: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in entries.items())
    return f"CASE {key} {whens} END"


def era(lowered: str) -> str:
    return cascade(lowered, L.ERA_RULES, "''")


def tourism(era_name: str, lowered: str, name: str) -> str:
    combined = f"({lowered} || ' ' || lower({name}))"
    return member(era_name, L.TOURISM_BY_ERA, cascade(combined, L.TOURISM_RULES, q(L.TOURISM_DEFAULT)))


def place(name: str, lowered: str, rules=L.PLACE_RULES) -> str:
    return cascade(f"(lower({name}) || ' ' || {lowered})", rules, q(L.PLACE_DEFAULT))


def known_place(name: str) -> str:
    return cascade(f"lower({name})", [([p], r) for p, r in L.KNOWN_PLACES], "NULL")


def alias(hint: str) -> str:
    return lookup(L.REGION_ALIASES, f"lower({strip(hint)})")


def official_site(name: str) -> str:
    return cascade(f"lower({name})", L.OFFICIAL_SITE_RULES, "''")


def duration(name: str, kind: str) -> str:
    typed = member(f"lower({kind})", L.DURATION_BY_TYPE, q(L.DEFAULT_DURATION))
    return f"CASE WHEN {any_contains(f'lower({name})', L.LARGE_COMPLEXES)} THEN {q(L.LARGE_DURATION)} ELSE {typed} END"


def best_time(kind: str, city: str) -> str:
    by_town = member(f"lower({city})", [L.BEST_TIME_HOT], q(L.DEFAULT_BEST_TIME))
    return member(f"lower({kind})", L.BEST_TIME_BY_TYPE, by_town)


def context_tips(name: str, kind: str, tour: str, city: str) -> str:
    n, k = f"lower({name})", f"lower({kind})"
    by_type = (
        f"CASE WHEN {k} = 'pyramid' OR contains({n}, 'pyramid') THEN {texts(L.PYRAMID_TIPS)} "
        f"WHEN {k} = 'tomb' OR contains({n}, 'tomb') OR contains({n}, 'valley') THEN {texts(L.TOMB_TIPS)} "
        f"WHEN {k} = 'temple' THEN {texts(L.TEMPLE_TIPS)} WHEN {k} = 'museum' THEN {texts(L.MUSEUM_TIPS)} "
        f"WHEN {k} = 'mosque' THEN {texts(L.MOSQUE_TIPS)} "
        f"WHEN {k} IN ('church', 'monastery') THEN {texts(L.CHURCH_TIPS)} ELSE []::VARCHAR[] END"
    )

    def listed(x: str, rules) -> str:
        whens = " ".join(
            f"WHEN {x} IN ({', '.join(q(v) for v in values)}) THEN {texts([tip])}" for values, tip in rules
        )
        return f"CASE {whens} ELSE []::VARCHAR[] END"

    city_part, tour_part = listed(f"lower({city})", L.CITY_RULES), listed(f"lower({tour})", L.TOURISM_TIP_RULES)
    return f"({texts(L.GENERAL_TIPS)} || {by_type} || {city_part} || {tour_part})[1:{L.MAX_CONTEXT_TIPS}]"


def all_tips(name: str, kind: str, tour: str, city: str) -> str:
    site = official_site(name)
    closing = (
        f"list_filter([CASE WHEN {site} <> '' THEN 'Official website: ' || {site} END, "
        f"'Recommended visit duration: ' || {duration(name, kind)}, "
        f"'Best time to visit: ' || {best_time(kind, city)}], lambda ct: ct IS NOT NULL)"
    )
    return f"({context_tips(name, kind, tour, city)} || {closing})"


def phonetic(x: str) -> str:
    spoken = x
    for old, new in L.PHONETIC_RULES:
        spoken = f"regexp_replace({spoken}, {q(old)}, {q(new)}, 'gi')"
    hyphened = f"regexp_replace({spoken}, '([aeiou])([^aeiou])', '\\1-\\2', 'gi')"
    return title(f"CASE WHEN length({spoken}) > 6 THEN {hyphened} ELSE {spoken} END")


def pronounce(x: str) -> str:
    return f"coalesce({lookup(L.PRONUNCIATION, f'lower({strip(x)})')}, {phonetic(x)})"


def fact_test(s: str) -> str:
    m = marked(s)
    years = rf"(^|{NW})\d{{3,4}}\s*(?:(?:BC|BCE|AD|CE)({NW}|$)|(?:B\.C\.|A\.D\.)[\p{{L}}\p{{N}}_])"
    units = rf"(^|{NW})({'|'.join(L.FACT_UNITS)})({NWL}[^\n]*{NWL}|{NWL})\d+({NW}|$)"
    return (
        f"(regexp_matches({m}, {q(marked_pattern(L.FACT_SUPERLATIVES))}, 'i') "
        f"OR regexp_matches({m}, {q(marked_pattern(L.FACT_PHRASES))}, 'i') "
        f"OR regexp_matches({s}, {q(years)}, 'i') OR regexp_matches({s}, {q(units)}, 'i'))"
    )


def words(x: str) -> str:
    split = f"regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+')"
    return f"list_sort(list_distinct(list_filter({split}, lambda ww: ww <> '')))"


def name_parts(x: str) -> str:
    spaced = collapse(f"replace(replace(lower({x}), '-', ' '), '_', ' ')")
    return f"list_filter(string_split({spaced}, ' '), lambda np: np <> '')"


def overlap(name: str, title_: str) -> str:
    return f"len(list_filter({name_parts(name)}, lambda op: contains(lower({title_}), op)))"


def relevant(name: str, title_: str, snippet: str) -> str:
    return (
        f"({any_contains(f'lower({snippet})', L.RELEVANCE_KEYWORDS)} "
        f"OR {overlap(name, title_)} >= len({name_parts(name)}) // 2)"
    )


def variants(name: str, loc: str) -> str:
    low = f"lower({name})"
    parts = [name, f"CASE WHEN contains({name}, '-') THEN replace({name}, '-', ' ') END",
             f"CASE WHEN contains({name}, ' ') THEN replace({name}, ' ', '-') END"]
    for old, new in L.TRANSLITERATIONS:
        swapped = title(f"replace({low}, {q(old)}, {q(new)})")
        parts.append(f"CASE WHEN contains({low}, {q(old)}) THEN {swapped} END")
    bare = f"replace(replace({name}, 'The ', ''), 'the ', '')"
    parts += [
        f"CASE WHEN {loc} <> '' THEN {name} || ' (' || {loc} || ')' END",
        f"CASE WHEN {loc} <> '' THEN {name} || ', ' || {loc} END",
        f"CASE WHEN NOT contains({low}, 'temple') THEN {name} || ' Temple' END",
        f"CASE WHEN NOT contains({low}, 'temple') THEN 'Temple of ' || {name} END",
        f"CASE WHEN NOT contains({low}, 'pyramid') AND {any_contains(low, L.PYRAMID_FIELDS)} "
        f"THEN {name} || ' Pyramid' END",
        f"CASE WHEN {bare} <> {name} THEN {bare} END",
    ]
    return f"list_filter([{', '.join(parts)}], lambda sv: sv IS NOT NULL)"


def queries_of(name: str, loc: str) -> str:
    third = f"CASE WHEN {loc} <> '' THEN {name} || ' ' || {loc} END"
    return f"list_filter([{name} || ' {L.COUNTRY}', {name}, {third}], lambda sq: sq IS NOT NULL)"


def decode(x: str) -> str:
    for entity, char in H.ENTITIES:
        x = f"replace({x}, {q(entity)}, {q(char)})"
    return x


def visible(x: str) -> str:
    return f"regexp_replace({x}, {q(H.INVISIBLE)}, '', 'g')"


def inner_text(x: str) -> str:
    flat = f"regexp_replace({x}, '\\s+', ' ', 'g')"
    lines = f"regexp_replace({flat}, '(?i) *<br\\s*/?> *', chr(10), 'g')"
    return strip(decode(f"regexp_replace({lines}, '<[^>]*>', '', 'g')"))


def attribute(tag: str, name: str) -> str:
    pattern = q(rf"""(?is)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)')""")
    return decode(f"(regexp_extract({tag}, {pattern}, 1) || regexp_extract({tag}, {pattern}, 2))")


def heading(seen: str, otherwise: str) -> str:
    p = q(H.HEADING)
    inner = f"(regexp_extract({seen}, {p}, 1) || regexp_extract({seen}, {p}, 2))"
    return f"CASE WHEN regexp_matches({seen}, {p}) THEN {inner_text(inner)} ELSE {otherwise} END"


def arabic_heading(seen: str) -> str:
    h1 = inner_text(f"regexp_extract({seen}, '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1\\s*>', 1)")
    return f"CASE WHEN regexp_matches({h1}, '[\\x{{0600}}-\\x{{06FF}}]') THEN {h1} ELSE '' END"


def paragraphs(seen: str) -> str:
    body = inner_text(f"regexp_replace(pp, {q(H.PARAGRAPH_END)}, '')")
    return f"list_transform(regexp_split_to_array({seen}, {q(H.PARAGRAPH_START)})[2:], lambda pp: {body})"


def content(paras: str, stops: list[str] = L.STOP_PHRASES, least: int = L.MIN_PARAGRAPH) -> str:
    return f"list_filter({paras}, lambda cp: length(cp) > {least} AND NOT {any_contains('lower(cp)', stops)})"


def gallery(seen: str) -> str:
    zone = "regexp_replace(gz, '(?is)</(?:article|section)\\s*>.*$', '')"
    tags = f"flatten(list_transform(regexp_split_to_array({seen}, {q(H.GALLERY)})[2:], lambda gz: regexp_extract_all({zone}, '(?is)<img\\b([^>]*)>', 1)))"
    return f"list_filter(list_transform({tags}, lambda gt: {attribute('gt', 'src')}), lambda gs: gs <> '' AND NOT contains(lower(gs), 'logo'))"


def blank_to_null(x: str) -> str:
    return f"nullif({x}, '')"


def joined(x: str, sep: str = " | ") -> str:
    return f"array_to_string({x}, {q(sep)})"


def address(state: str, province: str) -> str:
    def norm(x: str) -> str:
        bare = f"lower({x})"
        for suffix in L.ADDRESS_SUFFIXES:
            bare = f"replace({bare}, {q(suffix)}, '')"
        return lookup(L.REGION_ALIASES, strip(bare))

    return f"coalesce({norm(state)}, {norm(province)})"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
        f"* pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    )
    return f"(2 * 6371.0088::DOUBLE * asin(sqrt(least({a}, 1.0::DOUBLE))))"


# ---- tables ---------------------------------------------------------------------------------------------
def _values(rows: list[tuple], columns: str) -> str:
    def cell(v) -> str:
        return str(v) if isinstance(v, int) else q(v).replace("\n", "' || chr(10) || '")

    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


PAGE_TYPE = f"({texts(L.PAGE_TYPES)})[(doc_id // 24) % 4 + 1]"
URL = f"{q(C.SITE_URL)} || {PAGE_TYPE} || '/' || doc_id"
IMAGE = "'https://img.example/' || doc_id || '.jpg'"
UNIQUE = "(seed_name || ' ' || doc_id)"
LAT_TEXT = "((doc_id % 11 + 21) || '.' || lpad((doc_id * 37 % 10000)::VARCHAR, 4, '0'))"
LON_TEXT = "(CASE WHEN k = 8 THEN 'east' ELSE (doc_id % 13 + 24) || '.' || lpad((doc_id * 91 % 10000)::VARCHAR, 4, '0') END)"


def _detail(head: str) -> str:
    return (
        "'<html><head><script>var t=''<p>'';</script></head><body><h1> ' || " + head
        + " || ' </h1><article><img src=\"https://img.example/logo.png\"><img src=\"https://img.example/g/' || doc_id"
        + " || '.jpg\"><p>' || phrase || '</p><p>' || replace(text, chr(10), '</p><p>') || "
        + "'</p></article><p>All rights reserved by the people who developed it.</p></body></html>'"
    )


ARTICLE_TITLE = (
    "(CASE WHEN contains(article_title, '#') THEN replace(article_title, '#', doc_id::VARCHAR) "
    "ELSE article_title || ' ' || doc_id END)"
)
AR_TITLE = f"({q(C.AR_TITLE)} || ' ' || doc_id)"
TERM_KEYS = sorted({w.lower() for _, ws in L.TERM_CATEGORIES for w in ws})
BOOK = [(p[0], p[1]) for phrases in L.PHRASE_BOOK_EXT.values() for p in phrases]


def _terms_cte() -> str:
    found = ", ".join(
        find_words("m", ws, L.TERM_NUMERAL if c == "pharaoh" else "") + f" AS w{i}"
        for i, (c, ws) in enumerate(L.TERM_CATEGORIES)
    )
    every = " || ".join(
        f"list_transform(w{i}, lambda tx: {{'term': tx, 'category': {q(c)}}})" for i, (c, _) in enumerate(L.TERM_CATEGORIES)
    )
    return (
        f"SELECT key, name, list_filter(every, lambda te, ti: list_position(low, lower(te.term)) = ti) AS terms FROM ("
        f"SELECT *, list_transform(every, lambda tl: lower(tl.term)) AS low FROM (SELECT *, {every} AS every FROM ("
        f"SELECT *, {found} FROM (SELECT *, {marked('text')} AS m FROM glossary_in))))"
    )


SUBS = " || ".join(
    f"list_transform(regexp_extract_all(full_description, {q(p)}, 1, 'i'), lambda sm: {q(prefix)} || {title('sm')})"
    for p, prefix in L.SUB_LOCATION_PATTERNS
)

NOTICE_DAY = f"({texts(L.WEEKDAYS)})[(length(line) + li - 1) % 7 + 1]"
NOTICE_HOUR, NOTICE_MINUTE = "(length(line) % 12 + 1)", "lpad((length(line) * 7 % 60)::VARCHAR, 2, '0')"
NOTICE = (
    f"CASE length(line) % 5 WHEN 0 THEN {NOTICE_DAY} || ': ' || {NOTICE_HOUR} || ':' || {NOTICE_MINUTE} || ' AM - ' || (length(line) % 7 + 1) || ' PM' "
    f"WHEN 1 THEN {NOTICE_DAY} || ' closed' "
    f"WHEN 2 THEN lower({NOTICE_DAY}) || ' ' || lpad({NOTICE_HOUR}::VARCHAR, 2, '0') || ':' || {NOTICE_MINUTE} || '–' || ({NOTICE_HOUR} + 9) || ':30' "
    f"WHEN 3 THEN {NOTICE_DAY} || ' ' || {NOTICE_HOUR} || ' am to ' || (length(line) % 5 + 3) || ' PM' "
    f"ELSE 'Open daily from ' || {NOTICE_HOUR} END"
)
TOLD_HOURS = f"CASE (doc_id + li - 1) % 3 WHEN 0 THEN {NOTICE} || ' ' || line WHEN 1 THEN line || ' ' || {NOTICE} ELSE line END"


def placed(key: str, notice: str) -> str:
    first = "string_split(body, chr(10))[1]"
    return (
        f"CASE {key} % 4 WHEN 0 THEN {notice} || ' ' || body WHEN 1 THEN body || ' ' || {notice} "
        f"WHEN 2 THEN {first} || ' ' || {notice} || substr(body, length({first}) + 1) ELSE body END"
    )


CTES: dict[str, tuple[list[str], str]] = {
    "seed": ([], _values(C.SEEDS, "k, seed_name, hint, phrase, article_title, arabic_name, has_page, geo, state, province")),
    "seeded": (["seed"], f"SELECT *, {UNIQUE} AS unique_name FROM (SELECT doc_id, text, doc_id % 24 AS k FROM documents) JOIN seed USING (k)"),
    "sites": (
        ["seeded"],
        f"SELECT doc_id AS site_key, {PAGE_TYPE} AS page_type, doc_id AS pos, seed_name AS name, unique_name, hint AS location, "
        f"{URL} AS url, phrase || ' ' || text AS full_description, phrase || ' ' || text AS description FROM seeded",
    ),
    "classed": (
        ["sites"],
        f"SELECT *, {tourism('era', 'lowered', 'name')} AS tourism_type, {place('name', 'lowered')} AS place_type FROM "
        f"(SELECT *, {era('lowered')} AS era FROM (SELECT *, lower(full_description) AS lowered FROM sites))",
    ),
    "listing": (
        ["seeded"],
        f"SELECT {URL} AS url, unique_name AS name, hint AS location, phrase || ' ' || text AS description, "
        f"{IMAGE} AS image, {PAGE_TYPE} AS page_type, doc_id AS pos FROM seeded",
    ),
    "listing_pages": (
        ["seeded"],
        f"SELECT {PAGE_TYPE} AS page_type, doc_id AS page_id, "
        f"'<html><body><a class=\"menu\" href=\"/en/home\">Home</a><a class=\"listItem box\" href=\"' || {URL} || '\" title=\"' || unique_name "
        "|| '\"><div class=\"location\"><i></i><p> ' || hint || ' </p></div><div class=\"details\"><p>' || phrase || ' ' || text || "
        f"'</p></div><img src=\"' || {IMAGE} || '\"></a><a class=\"listItem\" title=\"No address\"><div class=\"details\"><p>None</p></div></a></body></html>' AS html FROM seeded",
    ),
    "detail_pages": (
        ["seeded"],
        f"SELECT {URL} AS url, {_detail('unique_name')} AS html FROM seeded WHERE has_page = 1 UNION ALL "
        f"SELECT replace({URL}, '/en/', '/ar/'), {_detail('arabic_name')} FROM seeded WHERE arabic_name IS NOT NULL",
    ),
    "articles": (
        ["seeded"],
        f"SELECT 'en' AS lang, {ARTICLE_TITLE} AS title, phrase AS summary, phrase || ' ' || text AS text, "
        f"'https://en.wiki.example/' || replace({ARTICLE_TITLE}, ' ', '_') AS url, "
        f"CASE WHEN doc_id % 2 = 0 THEN {AR_TITLE} END AS ar_link FROM seeded WHERE article_title IS NOT NULL UNION ALL "
        f"SELECT 'ar', {AR_TITLE}, arabic_name || '[1] ' || text, arabic_name, 'https://ar.wiki.example/' || doc_id, NULL "
        "FROM seeded WHERE arabic_name IS NOT NULL",
    ),
    "gazetteer": (
        ["seeded"],
        f"SELECT CASE WHEN geo = 1 AND hint <> '' THEN unique_name || ', ' || hint || ', {L.COUNTRY}' ELSE unique_name || ', {L.COUNTRY}' END AS query, "
        f"1 AS rank, {LAT_TEXT} AS lat, {LON_TEXT} AS lon, state, province FROM seeded WHERE geo > 0",
    ),
    "site_points": (
        ["seeded"],
        f"SELECT doc_id AS site_key, try_cast({LAT_TEXT} AS DOUBLE) AS lat, try_cast({LON_TEXT} AS DOUBLE) AS lon FROM seeded",
    ),
    "gazetteer_points": (
        [],
        "SELECT 'Place ' || c_custkey AS place, 21 + (c_custkey * 17 % 1100) / 100.0::DOUBLE AS lat, "
        f"24 + (c_custkey * 29 % 1300) / 100.0::DOUBLE AS lon, ({texts(L.REGION_NAMES)})[c_nationkey + 1] AS region FROM customer",
    ),
    "map_captures": (
        [],
        f"SELECT doc_id, array_to_string(list_transform(string_split(body, chr(10)), lambda line, li: {TOLD_HOURS}), chr(10)) AS hours_text, "
        f"{placed('doc_id', 'rated')} AS rating_text, {placed('(doc_id + 1)', 'reviewed')} AS review_text, map_url "
        "FROM (SELECT doc_id, coalesce(text, '') AS body, length(coalesce(text, '')) AS size, ((size // 10) % 7) || '.' || (size % 10) || ' stars' AS rated, "
        "format('{:,}', size * (doc_id % 5 + 1)) AS number, "
        "CASE size % 3 WHEN 0 THEN '(' || number || ') Reviews' WHEN 1 THEN number || ' reviews' ELSE number || 'REVIEW' END AS reviewed FROM documents) "
        "LEFT JOIN (SELECT page_id AS doc_id, length(html) AS markup, "
        "'/@' || (markup % 32) || '.' || markup || ',-' || (markup % 60) || '.' || length(url) || ',15z' AS point, "
        "CASE WHEN markup % 10 = 0 THEN url WHEN markup % 2 = 0 THEN url || point ELSE regexp_replace(url, '^(https?://[^/]*)', '\\1' || point) END AS map_url "
        "FROM pages) USING (doc_id)",
    ),
    "names": (["listing"], "SELECT DISTINCT name, location FROM listing"),
    "en_titles": (["articles"], f"SELECT title, {words('title')} AS title_words, summary FROM articles WHERE lang = 'en'"),
    "exact": (
        ["names", "en_titles"],
        "SELECT name, location, arg_min(title, pos) AS title, min(pos) AS variant_pos FROM (SELECT name, location, "
        f"unnest(v) AS title, unnest(range(len(v))) AS pos FROM (SELECT *, {variants('name', 'location')} AS v FROM names)) "
        "JOIN en_titles USING (title) GROUP BY ALL",
    ),
    "asked": (
        ["names"],
        f"SELECT name, location, query_pos, {words('query')} AS word_set FROM (SELECT name, location, unnest(v) AS query, "
        f"unnest(range(len(v))) AS query_pos FROM (SELECT *, {queries_of('name', 'location')} AS v FROM names))",
    ),
    "hits": (
        ["asked", "en_titles"],
        "SELECT * FROM (SELECT word_set, title, overlap, row_number() OVER (PARTITION BY word_set ORDER BY overlap DESC, length(title), title) AS rank "
        "FROM (SELECT word_set, title, len(list_intersect(word_set, title_words)) AS overlap FROM (SELECT DISTINCT word_set FROM asked) "
        "JOIN en_titles ON list_has_any(word_set, title_words))) WHERE rank <= 5",
    ),
    "fuzzy_all": (
        ["hits"],
        "SELECT name, location, title, query_pos, rank FROM (SELECT *, row_number() OVER (PARTITION BY name, location ORDER BY query_pos, rank) AS n "
        "FROM asked JOIN hits USING (word_set) JOIN (SELECT title, summary FROM en_titles) USING (title) "
        f"WHERE {relevant('name', 'title', 'summary')}) WHERE n = 1",
    ),
    "matched": (
        ["exact", "fuzzy_all"],
        "SELECT name, location, title, 'exact' AS how FROM exact UNION ALL SELECT name, location, title, 'search' FROM fuzzy_all "
        "WHERE (name, location) NOT IN (SELECT (name, location) FROM exact)",
    ),
    "twins": (
        ["articles"],
        f"SELECT e.title, a.title AS arabic_title, {clean('left(a.summary, 500)')} AS arabic_summary, a.url AS arabic_url "
        "FROM articles e JOIN articles a ON e.ar_link = a.title WHERE e.lang = 'en' AND a.lang = 'ar'",
    ),
    "dictionary": (
        ["twins"],
        "SELECT term, arg_min(arabic, (src, arabic)) AS arabic FROM (SELECT lower(english) AS term, arabic, 0 AS src FROM "
        f"({_values(BOOK, 'english, arabic')}) UNION ALL SELECT lower(trim(title)), arabic_title, 1 FROM twins) GROUP BY term",
    ),
    "article_entities": (
        ["articles"],
        f"SELECT title, {distinct('figs')}[1:{L.MAX_FIGURES}] AS key_figures, {distinct('feats')} AS architectural_features, "
        f"{distinct('told')}[1:{L.MAX_FACTS}] AS unique_facts, "
        "coalesce(periods[1], '') AS historical_period FROM (SELECT title, "
        f"{find_words('m', L.ARTICLE_PHARAOHS, L.ARTICLE_NUMERAL)} || {find_words('m', L.ARTICLE_DEITIES)} AS figs, "
        f"list_transform({find_words('m', L.ARTICLE_FEATURES)}, lambda ft: {title('ft')}) AS feats, "
        f"{find_words('mi', L.ARTICLE_PERIODS)} AS periods, "
        f"list_transform(list_filter({sentences('text')}, lambda fs: length(fs) BETWEEN 30 AND 300 AND {fact_test('fs')}), lambda fc: {clean('fc')}) AS told "
        f"FROM (SELECT *, {marked('text')} AS m, {marked('left(text, 2000)')} AS mi FROM articles WHERE lang = 'en'))",
    ),
    "article_facts": (
        ["article_entities", "twins", "articles"],
        f"SELECT a.title, {clean('a.summary')} AS summary, a.url AS article_url, left(a.text, 2000) AS intro, unique_facts, key_figures, architectural_features, historical_period, "
        "coalesce(arabic_title, '') AS arabic_title, coalesce(arabic_summary, '') AS arabic_summary, coalesce(arabic_url, '') AS arabic_url "
        "FROM articles a JOIN article_entities USING (title) LEFT JOIN twins USING (title) WHERE a.lang = 'en'",
    ),
    "forward": (
        ["names", "gazetteer"],
        "SELECT name, location, arg_min(region, pos) AS region FROM (SELECT name, location, 0 AS pos, "
        f"CASE WHEN location <> '' THEN name || ', ' || location || ', {L.COUNTRY}' END AS query FROM names UNION ALL "
        f"SELECT name, location, 1, name || ', {L.COUNTRY}' FROM names) JOIN (SELECT query, {address('state', 'province')} AS region FROM gazetteer "
        "WHERE rank = 1) USING (query) WHERE region IS NOT NULL GROUP BY ALL",
    ),
    "saved_reverse": (
        ["seeded"],
        f"SELECT lat, lon, min(region) AS region FROM (SELECT try_cast({LAT_TEXT} AS DOUBLE) AS lat, try_cast({LON_TEXT} AS DOUBLE) AS lon, {address('state', 'province')} AS region "
        "FROM seeded WHERE doc_id IN (SELECT doc_id FROM labels)) WHERE lat IS NOT NULL AND lon IS NOT NULL AND region IS NOT NULL GROUP BY lat, lon",
    ),
    "nearest_of_any": (
        ["site_points", "gazetteer_points"],
        "SELECT lat, lon, best.place AS place, best.region AS region, best.km AS distance_km FROM (SELECT s.lat, s.lon, min({'km': "
        f"{haversine('s.lat', 's.lon', 'p.lat', 'p.lon')}, 'place': p.place, 'region': p.region}}) AS best FROM (SELECT DISTINCT lat, lon FROM site_points "
        "WHERE lat IS NOT NULL AND lon IS NOT NULL) s, gazetteer_points p GROUP BY s.lat, s.lon)",
    ),
    "nearest": (
        ["site_points", "gazetteer_points"],
        "SELECT lat, lon, place, region, km AS distance_km FROM (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY km, place) AS n FROM ("
        f"SELECT s.lat, s.lon, p.place, p.region, {haversine('s.lat', 's.lon', 'p.lat', 'p.lon')} AS km FROM (SELECT DISTINCT lat, lon FROM site_points "
        "WHERE lat IS NOT NULL AND lon IS NOT NULL) s JOIN gazetteer_points p ON abs(s.lat - p.lat) <= 0.25 AND abs(s.lon - p.lon) <= 0.25) WHERE km <= 20) WHERE n = 1",
    ),
    "page_texts": (
        ["detail_pages"],
        f"SELECT url, {heading('seen', 'NULL')} AS page_heading, {joined(content('paras'), chr(10) + chr(10))} AS full_description, {gallery('seen')} AS gallery, "
        f"{arabic_heading('seen')} AS arabic_heading FROM (SELECT *, {paragraphs('seen')} AS paras FROM (SELECT url, {visible('html')} AS seen FROM detail_pages))",
    ),
    "page_rows": (
        ["listing", "page_texts"],
        f"SELECT *, {tourism('era', 'lowered', 'heading')} AS tourism_type, {place('heading', 'lowered')} AS place_type FROM (SELECT *, {era('lowered')} AS era FROM ("
        "SELECT l.*, coalesce(p.page_heading, l.name) AS heading, p.full_description, lower(p.full_description) AS lowered, "
        f"coalesce(a.arabic_heading, '') AS arabic_name, {distinct('([l.image] || p.gallery)')}[1:{L.MAX_IMAGES}] AS images "
        "FROM listing l JOIN page_texts p USING (url) LEFT JOIN page_texts a ON a.url = replace(l.url, '/en/', '/ar/')))",
    ),
    "coords": (
        ["gazetteer"],
        "SELECT query, CASE WHEN try_cast(lat AS DOUBLE) IS NOT NULL AND try_cast(lon AS DOUBLE) IS NOT NULL THEN try_cast(lat AS DOUBLE) END AS latitude, "
        "CASE WHEN try_cast(lat AS DOUBLE) IS NOT NULL AND try_cast(lon AS DOUBLE) IS NOT NULL THEN try_cast(lon AS DOUBLE) END AS longitude FROM gazetteer WHERE rank = 1",
    ),
    "page_facts": (
        ["page_rows", "coords"],
        f"SELECT r.*, latitude, longitude FROM page_rows r LEFT JOIN coords ON query = heading || ', {L.COUNTRY}'",
    ),
    "known": (
        ["page_facts", "matched", "article_facts", "forward", "dictionary", "nearest_all", "saved_reverse"],
        f"SELECT f.*, 'site_' || lpad(number::VARCHAR, greatest(3, length(number::VARCHAR))::INT, '0') AS id, af.* EXCLUDE (title), coalesce(d.arabic, '') AS name_arabic, "
        f"coalesce({known_place('f.name')}, {alias('f.location')}, fw.region, sr.region, nr.region, f.location) AS governorate "
        f"FROM (SELECT *, row_number() OVER (ORDER BY list_position({texts(L.PAGE_TYPES)}, page_type), pos) AS number FROM page_facts) f "
        "LEFT JOIN matched m ON m.name = f.name AND m.location = f.location LEFT JOIN article_facts af ON af.title = m.title "
        "LEFT JOIN forward fw ON fw.name = f.name AND fw.location = f.location LEFT JOIN dictionary d ON d.term = lower(trim(f.name)) "
        "LEFT JOIN nearest_all nr ON nr.lat = f.latitude AND nr.lon = f.longitude LEFT JOIN saved_reverse sr ON sr.lat = f.latitude AND sr.lon = f.longitude",
    ),
    "nearest_all": (
        ["page_facts", "gazetteer_points"],
        "SELECT lat, lon, region FROM (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY km, place) AS n FROM ("
        f"SELECT s.lat, s.lon, p.place, p.region, {haversine('s.lat', 's.lon', 'p.lat', 'p.lon')} AS km FROM (SELECT DISTINCT latitude AS lat, longitude AS lon FROM page_facts "
        "WHERE latitude IS NOT NULL) s JOIN gazetteer_points p ON abs(s.lat - p.lat) <= 0.25 AND abs(s.lon - p.lon) <= 0.25) WHERE km <= 20) WHERE n = 1",
    ),
    "glossary_in": (
        ["known"],
        "SELECT id AS key, name, name || ' ' || full_description || CASE WHEN intro IS NULL THEN '' ELSE ' ' || intro END AS text FROM known",
    ),
    "terms": (["glossary_in"], _terms_cte()),
    "glossary": (
        ["terms", "dictionary", "known"],
        "SELECT key, CASE WHEN len(entries) < 8 AND name_arabic <> '' AND NOT list_contains(list_transform(entries, lambda ga: ga.arabic), name_arabic) "
        f"THEN [{{'english': name, 'arabic': name_arabic, 'pronunciation': {pronounce('name')}, 'context': 'site_name'}}] || entries ELSE entries END AS entries FROM ("
        "SELECT t.key, t.name, k.name_arabic, list_transform(t.terms[1:8], lambda ge: {'english': CASE WHEN length(ge.term) > 3 THEN "
        f"{title('ge.term')} ELSE ge.term END, 'arabic': coalesce(dict[lower(ge.term)], ''), 'pronunciation': {pronounce('ge.term')}, 'context': ge.category}}) AS entries "
        "FROM terms t JOIN (SELECT id, name_arabic FROM known) k ON k.id = t.key, "
        f"(SELECT map_from_entries(list((term, arabic))) AS dict FROM dictionary WHERE term IN ({', '.join(q(t) for t in TERM_KEYS)})))",
    ),
    "subs": (
        ["known"],
        "SELECT id, name, full_description, CASE WHEN len(found) > 0 THEN list_transform(found, lambda sf, si: {'id': id || '_sub_' || lpad(si::VARCHAR, 2, '0'), "
        "'name': sf, 'short': 'Notable feature of ' || name, 'full': ''}) ELSE [{'id': id || '_sub_01', 'name': name, 'short': CASE WHEN full_description <> '' "
        "THEN left(full_description, 200) ELSE 'Archaeological site: ' || name END, 'full': full_description}] END AS subs FROM ("
        f"SELECT *, {distinct('every')}[1:5] AS found FROM (SELECT id, name, full_description, {SUBS} AS every FROM known))",
    ),
    "site": (
        ["known", "glossary", "subs"],
        "SELECT k.id, k.name, arabic_name AS \"arabicName\", coalesce(nullif(historical_period, ''), era) AS era, tourism_type AS \"tourismType\", place_type AS \"placeType\", "
        "governorate, latitude, longitude, left(description, 200) AS \"shortDescription\", k.full_description AS \"fullDescription\", images AS \"imageNames\", "
        f"{duration('k.name', 'place_type')} AS \"estimatedDuration\", {best_time('place_type', 'governorate')} AS \"bestTimeToVisit\", '' AS \"openingHours\", "
        f"{official_site('k.name')} AS \"officialWebsite\", subs, {all_tips('k.name', 'place_type', 'tourism_type', 'governorate')} AS tips, entries, "
        "coalesce(unique_facts, []) AS facts, coalesce(key_figures, []) AS figures, coalesce(architectural_features, []) AS features, coalesce(article_url, '') AS \"wikipediaUrl\", "
        "page_type, url FROM known k JOIN glossary g ON g.key = k.id JOIN subs s ON s.id = k.id",
    ),
}


def _order(names: list[str], seen: list[str]) -> list[str]:
    for name in names:
        _order(CTES[name][0], seen)
        if name not in seen:
            seen.append(name)
    return seen


def query(needs: list[str], final: str, **extra: str) -> str:
    """A statement with the CTEs it needs; ``extra`` ones come last, in the order given."""
    parts = [f"{name} AS ({CTES[name][1]})" for name in _order(needs, [])]
    parts += [f"{name} AS ({sql})" for name, sql in extra.items()]
    return f"WITH {', '.join(parts)} {final}" if parts else final
