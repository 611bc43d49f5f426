"""Schemas of stored inputs and outputs, as DDL (the shape ``spark.read.schema`` takes)."""

LISTING = (
    "url STRING, name STRING, location STRING, description STRING, image STRING, page_type STRING, pos LONG"
)
PAGE = "url STRING, html STRING"
ARTICLE = (
    "lang STRING, title STRING, summary STRING, text STRING, url STRING, langlinks MAP<STRING, STRING>"
)
GEO_ANSWER = "STRUCT<lat: STRING, lon: STRING, address: MAP<STRING, STRING>>"
GAZETTEER = "query STRING, rank INT, lat STRING, lon STRING, address MAP<STRING, STRING>"
GAZETTEER_POINT = "place STRING, lat DOUBLE, lon DOUBLE, region STRING"
DICTIONARY = "english STRING, arabic STRING"
SEARCH_ANSWER = "query STRUCT<search: ARRAY<STRUCT<title: STRING, snippet: STRING>>>"
PROCESSED = "url STRING, name STRING, page_type STRING, status STRING, batch STRING, updated_at TIMESTAMP"
COMPLETED_TYPE = "page_type STRING, updated_at TIMESTAMP"
CHECKPOINT = (
    "processed_urls ARRAY<STRING>, processed_names ARRAY<STRING>, page_types_completed ARRAY<STRING>, "
    "current_page_type STRING, total_processed LONG, last_updated STRING, version STRING"
)
EXISTING_OUTPUT = "sites ARRAY<STRUCT<name: STRING>>"

SUB_LOCATION = (
    "id: STRING, siteId: STRING, name: STRING, arabicName: STRING, shortDescription: STRING, "
    "imageName: STRING, fullDescription: STRING"
)
TERM = "english: STRING, arabic: STRING, pronunciation: STRING, context: STRING"
SITE = (
    "id STRING, name STRING, arabicName STRING, era STRING, tourismType STRING, placeType STRING, "
    "governorate STRING, latitude DOUBLE, longitude DOUBLE, shortDescription STRING, "
    "fullDescription STRING, imageNames ARRAY<STRING>, estimatedDuration STRING, "
    "bestTimeToVisit STRING, openingHours STRING, officialWebsite STRING, "
    f"subLocations ARRAY<STRUCT<{SUB_LOCATION}>>, tips ARRAY<STRING>, arabicPhrases ARRAY<STRUCT<{TERM}>>, "
    "uniqueFacts ARRAY<STRING>, keyFigures ARRAY<STRING>, architecturalFeatures ARRAY<STRING>, "
    "wikipediaUrl STRING, rating DOUBLE, reviewCount INT"
)
# The nineteen exported columns of a site, in export order.
EXPORTED_SITE = [
    "id", "name", "arabicName", "era", "tourismType", "placeType", "governorate", "latitude", "longitude",
    "shortDescription", "imageNames", "estimatedDuration", "bestTimeToVisit", "openingHours",
    "officialWebsite", "uniqueFacts", "keyFigures", "architecturalFeatures", "wikipediaUrl",
]
