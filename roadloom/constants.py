"""Fixed values.

Everything in this file has to be exactly what users of the extracts already
rely on (class names, area rectangles, marker phrases, rule factors, licence
texts); none of it is logic.
"""

# --- fixed values: road classes, in display order -------------------------
CLASS_ORDER = [
    "motorway", "trunk", "primary", "secondary", "tertiary",
    "unclassified", "residential", "living_street",
]
CLASSIFIED = ["motorway", "trunk", "primary", "secondary", "tertiary"]
MINOR_CLASSES = ["unclassified", "residential", "living_street"]
MAP_CLASSES = ["motorway", "trunk"]

# --- fixed values: geometry ------------------------------------------------
EARTH_RADIUS_KM = 6371.0088      # mean earth radius
WGS84_A = 6378137.0              # semi-major axis, metres
WGS84_F = 1 / 298.257223563      # flattening
SIMPLIFY_DEG = 0.0005
COORD_DECIMALS = 5
CELLS_PER_DEGREE = 100           # 0.01 degree grid
VIEWPORT_PAD_DEG = 0.006

GEOMETRY_COLUMNS = [
    "geom_type", "lon", "lat", "length_km",
    "bbox_min_lon", "bbox_min_lat", "bbox_max_lon", "bbox_max_lat",
    "geometry_geojson",
]

# --- fixed values: named areas (xmin, ymin, xmax, ymax) ---------------------
AREAS = {
    "germany": ("Germany", (5.87, 47.27, 15.04, 55.06)),
    "bayern": ("Bayern", (8.97, 47.27, 13.84, 50.56)),
    "nrw": ("Nordrhein-Westfalen", (5.86, 50.32, 9.46, 52.53)),
    "berlin-brandenburg": ("Berlin-Brandenburg", (11.26, 51.36, 14.77, 53.56)),
    "berlin": ("Berlin", (13.08, 52.33, 13.77, 52.68)),
    "saarland": ("Saarland", (6.35, 49.11, 7.40, 49.64)),
    "frankfurt": ("Frankfurt am Main", (8.47, 50.02, 8.80, 50.23)),
}

# --- fixed values: labels in the data ---------------------------------------
OUTSIDE = "outside DE"
MEASURED = "Overture release"
SIMULATED = "simulated"

# --- fixed values: the one known incident ------------------------------------
INCIDENT_NAME = "Conflation regression (synthetic)"
INCIDENT_STATES = ["Bayern", "Baden-Württemberg"]
INCIDENT_CLASSES = ["tertiary", "residential", "unclassified"]
INCIDENT_WEEKS = {"2026-08-05": 0.91, "2026-08-12": 0.96}

# --- fixed values: leaf columns a scan touches -------------------------------
SEGMENT_LEAVES = [
    "subtype", "class", "bbox, xmin", "bbox, ymin", "names, primary", "id", "geometry",
]
DIVISION_LEAVES = ["country", "subtype", "names, primary", "geometry"]
PLACE_LEAVES = [
    "bbox, xmin", "bbox, ymin", "id", "names, primary", "basic_category",
    "taxonomy, primary", "confidence", "operating_status",
    "addresses, list, element, locality", "geometry",
]

# --- fixed values: scope record texts ------------------------------------------
SCOPE_TEXTS = {
    "state_attribution": "centroid snapped to 0.01 degree grid",
    "length": "ST_Length_Spheroid on full geometry",
    "map_geometry": "simplified 0.0005 deg, 5 decimals",
    "source": "Overture Maps Foundation, overturemaps.org",
    "license": "ODbL-1.0",
    "license_url": "https://opendatacommons.org/licenses/odbl/",
    "attribution": (
        "Road and boundary data © OpenStreetMap contributors, Overture Maps Foundation. "
        "Available under the Open Database License (ODbL)."
    ),
}

# --- fixed values: texts that count as "missing" in CSV input --------------------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
CSV_DELIMITERS = [",", ";", "\t", "|"]
DATE_COLUMN_SHARE = 0.8

# --- fixed values: phrases that mark an answer as a refusal ----------------------
REFUSAL_MARKERS = [
    "cannot", "can't", "can not", "unable", "not available", "no data", "not contain",
    "doesn't contain", "does not include", "doesn't include", "not included",
    "no information", "not possible", "isn't possible", "no column", "not in the",
    "don't have", "do not have", "nicht", "keine", "kein ", "leider",
]

# --- fixed values: read-only statement rule ----------------------------------------
STATEMENT_STARTS = ["select", "with", "describe", "show", "summarize"]
FILE_READERS = ["read_csv", "read_json", "read_parquet", "read_text", "read_blob", "glob"]
WRITE_KEYWORDS = [
    "insert", "update", "delete", "drop", "alter", "create", "attach", "detach", "copy",
    "export", "import", "install", "load", "pragma", "set", "reset", "call", "truncate",
    "vacuum", "checkpoint", "grant", "revoke", "begin", "commit", "rollback",
]

# --- fixed values: columns that are offered -------------------------------------------
TOP_DELTAS = 16
HIGHLIGHT_COLUMNS = {("roads", "class"), ("places", "category"), ("places", "basic_category")}
BREAKDOWN_COLUMNS = {"roads": "class", "places": "category"}
LONGITUDE_NAMES = ["lon", "lng", "longitude", "x"]
LATITUDE_NAMES = ["lat", "latitude", "y"]
