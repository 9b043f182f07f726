"""Fixed values.

Names, prefixes, patterns and limits that stored data, export files and users'
saved queries depend on. They must stay exactly as written here.
"""

# --- Fixed values: keys of one export record --------------------------------
KEY_TRACK_URI = "spotify_track_uri"
KEY_TITLE = "master_metadata_track_name"
KEY_ARTIST = "master_metadata_album_artist_name"
KEY_ALBUM = "master_metadata_album_album_name"
KEY_TIMESTAMP = "ts"
KEY_DURATION = "ms_played"
EXPORT_FILE_PATTERN = "*.json"

# --- Fixed values: URIs ------------------------------------------------------
URI_SCHEME = "spotify"
TRACK_URI_PREFIX = "spotify:track:"
LOCAL_ID_PREFIX = "local:"
LOCAL_ARTIST_PREFIX = "spotify:artist:local:"
LOCAL_URI_VERSION = "local:v1"
IDENTITY_SEPARATOR = "::"
IDENTITY_HASH_LENGTH = 12

# --- Fixed values: defaults shown to users -----------------------------------
DEFAULT_TITLE = "Unknown Title"
DEFAULT_ARTIST = "Unknown Artist"
LIST_SEPARATOR = ", "

# --- Fixed values: the published view and the tables behind it ---------------
HISTORY_VIEW = "v_listening_history"
RAW_RELATIONS = [
    "artists",
    "audio_features",
    "embeddings",
    "lyrics",
    "played_history",
    "tracks",
    "track_artists",
]

# --- Fixed values: limits ----------------------------------------------------
TEXT_LENGTH = 255
CONTEXT_TYPE_LENGTH = 50
VECTOR_WIDTH = 384
SEARCH_K = 10
ENCODER_BATCH = 256
QUERY_MAX_ROWS = 100
QUERY_TIMEOUT_MS = 5000

# --- Fixed values: embedding text --------------------------------------------
TEXT_PART_SEPARATOR = ". "
TEXT_DEFAULT_TITLE = "unknown title"
TEXT_DEFAULT_ARTIST = "unknown artist"

# --- Fixed values: statement audit, in the order the checks run ---------------
WRITE_KEYWORDS = [
    "insert",
    "update",
    "delete",
    "merge",
    "drop",
    "alter",
    "create",
    "truncate",
]
REASON_EMPTY = "SQL cannot be empty."
REASON_SEVERAL = "Only one SQL statement is allowed."
REASON_NOT_SELECT = "Only SELECT or WITH ... SELECT statements are allowed."
REASON_WRITES = "Data-changing SQL is not allowed."
REASON_NO_VIEW = "Queries must reference v_listening_history."
REASON_RAW_TABLES = (
    "Raw tables are unavailable; query only v_listening_history (found: {})."
)
