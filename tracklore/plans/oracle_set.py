"""The same queries as SQL over the supplied tables, for checking results."""

from __future__ import annotations

STAR = """
WITH t_tracks AS (
  SELECT 'spotify:track:' || p_partkey AS uri, p_name AS title, p_brand AS album_name,
         DATE '2000-01-01' + p_size * 30 AS release_date, p_size AS popularity,
         p_size * 1234 AS duration_ms
  FROM part
  UNION ALL
  SELECT 'spotify:track:local:v1:page-' || page_id, url, NULL, NULL, NULL, NULL FROM pages
), t_artists AS (
  SELECT 'spotify:artist:' || s_suppkey AS uri, s_name AS name,
         CASE WHEN s_acctbal >= 2000 THEN [n_name, r_name] END AS genres
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
), t_bridge AS (
  SELECT DISTINCT 'spotify:track:' || l_partkey AS track_uri,
         'spotify:artist:' || l_suppkey AS artist_uri
  FROM lineitem
), t_plays AS (
  SELECT event_id AS id,
         CASE event_type
           WHEN 'error' THEN 'spotify:track:local:v1:page-' || CAST(floor(value) AS BIGINT)
           WHEN 'signup' THEN 'spotify:track:' || CAST(floor(value * 100) AS BIGINT)
           ELSE 'spotify:track:' || CAST(floor(value * 10) AS BIGINT) END AS track_uri,
         ts AS played_at, event_type AS context_type,
         CAST(floor(value * 1000) AS INTEGER) AS played_time
  FROM events
), t_features AS (
  SELECT 'spotify:track:' || c_custkey AS track_uri, abs(c_acctbal) / 10000.0::DOUBLE AS valence,
         c_nationkey / 25.0::DOUBLE AS energy, (25 - c_nationkey) / 32.0::DOUBLE AS danceability,
         CASE WHEN c_acctbal >= 0 THEN c_acctbal / 50.0::DOUBLE END AS tempo,
         c_nationkey / 50.0::DOUBLE AS acousticness, CAST(NULL AS DOUBLE) AS instrumentalness,
         0.125::DOUBLE AS liveness, -c_acctbal / 1000.0::DOUBLE AS loudness,
         0.0625::DOUBLE AS speechiness
  FROM customer
), t_source AS (
  SELECT CAST(o_orderkey // 3 AS VARCHAR) AS id, o_totalprice / 1000000.0::DOUBLE AS valence,
         0.5::DOUBLE AS energy, 0.25::DOUBLE AS danceability,
         o_totalprice / 5000.0::DOUBLE AS tempo
  FROM orders
), t_source_one AS (
  SELECT id, max(valence) AS valence, 0.5::DOUBLE AS energy, 0.25::DOUBLE AS danceability,
         max(tempo) AS tempo, CAST(NULL AS DOUBLE) AS acousticness,
         CAST(NULL AS DOUBLE) AS instrumentalness, CAST(NULL AS DOUBLE) AS liveness,
         CAST(NULL AS DOUBLE) AS loudness, CAST(NULL AS DOUBLE) AS speechiness
  FROM t_source GROUP BY id
), t_vectors AS (
  SELECT 'spotify:track:' || vec_id AS track_uri, embedding FROM embeddings
), t_names AS (
  SELECT track_uri, string_agg(DISTINCT name, ', ' ORDER BY name) AS artist_names
  FROM t_bridge JOIN t_artists ON artist_uri = uri GROUP BY track_uri
), t_genres AS (
  SELECT track_uri, string_agg(DISTINCT g, ', ' ORDER BY g) AS artist_genres
  FROM (SELECT track_uri, unnest(genres) AS g FROM t_bridge JOIN t_artists ON artist_uri = uri)
  GROUP BY track_uri
), v_listening_history AS (
  SELECT p.id AS history_id, p.played_at, p.played_time, t.uri AS track_uri,
         t.title AS track_title, t.album_name, t.release_date, t.popularity,
         CAST(((t.duration_ms + 50) // 100) / 10.0 AS DOUBLE) AS duration_seconds,
         CAST(p.played_time / 1000.0 AS DOUBLE) AS played_time_seconds,
         coalesce(n.artist_names, 'Unknown Artist') AS artist_names, g.artist_genres,
         f.tempo, f.energy, f.danceability, f.valence
  FROM t_plays p JOIN t_tracks t ON p.track_uri = t.uri
  LEFT JOIN t_names n ON n.track_uri = t.uri
  LEFT JOIN t_genres g ON g.track_uri = t.uri
  LEFT JOIN t_features f ON f.track_uri = t.uri
)
"""

# Export records of the events, as they read back after a parse.
RECORDS = """
WITH r_raw AS (
  SELECT *, 'history-' || lpad(CAST(event_id // 1000 AS VARCHAR), 12, '0') || '.json' AS file_name,
         1 + row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) AS pos,
         CAST(floor(value * 10) AS BIGINT) AS k, CAST(floor(value * 1000) AS BIGINT) - 5000 AS ms
  FROM events
), r_typed AS (
  SELECT *,
    CASE event_type
      WHEN 'click' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'
      WHEN 'view' THEN strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || '+02:00'
      WHEN 'purchase' THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f')
      WHEN 'signup' THEN strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || '-05:00'
      ELSE CASE WHEN value < 5 THEN 'not-a-datetime'
           ELSE strftime(ts, '%Y%m%dT%H%M%S.%f') || 'Z' END END AS stamp,
    CASE WHEN event_type = 'click' THEN NULL WHEN event_type = 'view' AND value < 20 THEN ''
         ELSE 'spotify:track:' || k END AS given_uri,
    CASE WHEN event_type = 'purchase' AND value < 10 THEN NULL
         WHEN event_type = 'click' AND value < 3 THEN NULL ELSE 'Title ' || k END AS title,
    CASE WHEN event_type = 'signup' AND value < 30 THEN NULL
         ELSE 'Artist ' || user_id END AS artist,
    'Album ' || (props ->> '$.k') AS album,
    CASE WHEN event_type = 'view' AND value >= 100 THEN NULL
         WHEN event_type = 'error' AND value >= 100 THEN NULL
         WHEN event_type = 'error' THEN CAST(trunc(ms + 0.75::DOUBLE) AS BIGINT)
         ELSE ms END AS ms_played
  FROM r_raw
), r_norm AS (
  SELECT *,
    CASE WHEN given_uri <> '' THEN given_uri
         WHEN title <> '' AND artist <> '' THEN
           'spotify:track:local:v1:' || replace(lower(artist || ' ' || title), ' ', '-') || ':' ||
           substr(sha256(lower(artist || '::' || title)), 1, 12) END AS track_uri,
    CASE WHEN stamp <> 'not-a-datetime' THEN ts END AS played_at
  FROM r_typed
), r_checked AS (
  SELECT *,
    CASE WHEN track_uri IS NULL THEN 'missing_identity'
         WHEN played_at IS NULL THEN 'invalid_timestamp'
         WHEN event_type = 'view' AND value >= 100 THEN 'missing_duration'
         WHEN ms_played IS NULL THEN 'invalid_duration' END AS reason
  FROM r_norm
), r_plays AS (
  SELECT file_name, pos, track_uri, coalesce(title, 'Unknown Title') AS title,
         artist AS artist_name, album AS album_name, played_at,
         CAST(greatest(ms_played, 0) AS INTEGER) AS playback_ms
  FROM r_checked WHERE reason IS NULL
), r_tracks AS (
  SELECT track_uri AS uri, title, album_name FROM r_plays
  QUALIFY row_number() OVER (PARTITION BY track_uri ORDER BY file_name, pos) = 1
), r_named AS (
  SELECT *, 'spotify:artist:local:' || replace(lower(artist_name), ' ', '_') AS artist_uri
  FROM r_plays WHERE artist_name <> ''
), r_artists AS (
  SELECT artist_uri AS uri, artist_name AS name FROM r_named
  QUALIFY row_number() OVER (PARTITION BY artist_uri ORDER BY file_name, pos) = 1
), r_pairs AS (SELECT DISTINCT track_uri, artist_uri FROM r_named
), r_stored AS (SELECT DISTINCT track_uri, played_at FROM r_plays)
"""

_IMPORTED = """
SELECT 'tracks' AS table_name, count(*) AS n FROM r_tracks
UNION ALL SELECT 'artists', count(*) FROM r_artists
UNION ALL SELECT 'track_artists', count(*) FROM r_pairs
UNION ALL SELECT 'played_history', count(*) FROM r_stored
"""

_ROUNDED = "regexp_replace(printf('%.{d}f', {x}), '(\\.[0-9]+?)0+$', '\\1')"


def _rounded(x: str, digits: int) -> str:
    return _ROUNDED.format(d=digits, x=x)


_EMBEDDING_TEXT = f"""
SELECT t.uri AS track_uri, concat_ws('. ',
  'track ' || coalesce(nullif(t.title, ''), 'unknown title'),
  'by ' || coalesce(n.artist_names, 'Unknown Artist'),
  'album ' || nullif(t.album_name, ''),
  'tempo ' || {_rounded('f.tempo', 1)} || ' bpm',
  'energy ' || {_rounded('f.energy', 3)},
  'danceability ' || {_rounded('f.danceability', 3)},
  'valence ' || {_rounded('f.valence', 3)}) AS text
FROM t_tracks t LEFT JOIN t_names n ON n.track_uri = t.uri
LEFT JOIN t_features f ON f.track_uri = t.uri
WHERE t.uri NOT IN (SELECT track_uri FROM t_vectors)
"""

_CENTRES = """
WITH cells AS (
  SELECT {by} AS g, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i
  FROM embeddings
), centres AS (
  SELECT g, list(m ORDER BY i) AS vector
  FROM (SELECT g, i, avg(v) AS m FROM cells GROUP BY g, i) GROUP BY g
)
"""

_DISTANCE = "list_cosine_distance(embedding::DOUBLE[], vector)"

# Statement audit: the same checks, written for the oracle's regular expressions.
_AUDIT = r"""
WITH raw AS (
  SELECT event_id,
    CASE
      WHEN event_type = 'click' AND value < 20 THEN '```sql' || chr(10) || 'SELECT * FROM v_listening_history LIMIT ' || n || ';' || chr(10) || '```'
      WHEN event_type = 'click' AND value < 60 THEN '  select track_title from v_listening_history where track_title = ''Drop; ' || n || '''  ;'
      WHEN event_type = 'click' THEN 'WITH t AS (SELECT * FROM v_listening_history) SELECT * FROM t -- delete ' || n
      WHEN event_type = 'view' AND value < 20 THEN 'SELECT ' || n || '; SELECT 2'
      WHEN event_type = 'view' AND value < 60 THEN 'EXPLAIN SELECT * FROM v_listening_history'
      WHEN event_type = 'view' THEN '```' || chr(10) || chr(10) || '```'
      WHEN event_type = 'purchase' AND value < 20 THEN 'WITH x AS (DELETE FROM tracks RETURNING 1) SELECT ' || n || ' FROM x'
      WHEN event_type = 'purchase' AND value < 60 THEN 'SELECT ' || n || ' FROM somewhere'
      WHEN event_type = 'purchase' THEN 'SELECT * FROM v_listening_history v JOIN tracks t ON 1=1 join' || chr(10) || ' artists a on ' || n || '=1'
      WHEN event_type = 'signup' AND value < 20 THEN '/* from tracks; */ SELECT ' || n || ' FROM v_listening_history'
      WHEN event_type = 'signup' AND value < 60 THEN 'SELECT created_at, updates FROM v_listening_history WHERE n=''it''''s ' || n || ''''
      WHEN event_type = 'signup' THEN ' ; '
      WHEN event_type = 'error' AND value < 20 THEN 'SELECT x FROM v_listening_history_old'
      WHEN event_type = 'error' AND value < 60 THEN 'select * from v_listening_history, embeddings where 1=' || n
      ELSE 'SELECT * FROM v_listening_history WHERE a IN (SELECT uri FROM Played_History)'
    END AS raw
  FROM (SELECT *, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS n FROM events)
), unfenced AS (
  SELECT event_id, regexp_replace(regexp_replace(regexp_replace(raw,
    '^\s*```(?:sql)?\s*', '', 'i'), '\s*```\s*$', ''), '^\s+|\s+$', '', 'g') AS body
  FROM raw
), cleaned AS (
  SELECT event_id, CASE WHEN ends_with(body, ';')
    THEN regexp_replace(left(body, length(body) - 1), '^\s+|\s+$', '', 'g') ELSE body END AS sql
  FROM unfenced
), masked AS (
  SELECT event_id, sql, regexp_replace(regexp_replace(sql, '/\*.*?\*/|--[^\n]*', ' ', 'gs'),
    '''(?:''''|[^''])*''', '''''', 'g') AS m
  FROM cleaned
), lowered AS (
  SELECT *, lower(regexp_replace(m, '^\s+|\s+$', '', 'g')) AS l FROM masked
), named AS (
  SELECT *, list_sort(list_distinct([x
    for x in regexp_extract_all(l, '\b(?:from|join)\s+([a-z_][a-z0-9_]*)', 1)
    if x IN ('artists', 'audio_features', 'embeddings', 'lyrics', 'played_history', 'tracks',
             'track_artists')])) AS raw_tables
  FROM lowered
)
SELECT event_id, sql, CASE
  WHEN sql = '' THEN 'SQL cannot be empty.'
  WHEN contains(m, ';') THEN 'Only one SQL statement is allowed.'
  WHEN NOT regexp_matches(l, '^(select|with)\b')
    THEN 'Only SELECT or WITH ... SELECT statements are allowed.'
  WHEN regexp_matches(l, '\b(insert|update|delete|merge|drop|alter|create|truncate)\b')
    THEN 'Data-changing SQL is not allowed.'
  WHEN NOT regexp_matches(l, '\bv_listening_history\b')
    THEN 'Queries must reference v_listening_history.'
  WHEN len(raw_tables) > 0
    THEN 'Raw tables are unavailable; query only v_listening_history (found: '
         || array_to_string(raw_tables, ', ') || ').' END AS reason
FROM named
"""

_LOCAL_URI = r"""
WITH named AS (
  SELECT 'part-' || p_partkey AS item, 'track' AS kind, lower(trim(p_brand)) || '::' || lower(trim(p_name)) AS name FROM part
  UNION ALL
  SELECT 'supplier-' || s_suppkey, 'artist', lower(trim(s_name)) FROM supplier
  UNION ALL
  SELECT 'document-' || doc_id, 'track', lower(trim(source)) || '::' ||
    replace(lower(regexp_replace(nfc_normalize(text), '^\s+|\s+$', '', 'g')), 'ß', 'ss')
  FROM documents
), slugs AS (
  SELECT *, trim(regexp_replace(name, '[^\p{L}\p{N}_]+', '-', 'g'), '-') AS slug FROM named
)
SELECT item, 'spotify:' || kind || ':local:v1:' || CASE WHEN slug = '' THEN kind ELSE slug END
       || ':' || substr(sha256(name), 1, 12) AS uri
FROM slugs
"""

_MICRO = "array_to_string([CAST(round(v::DOUBLE * 1e6) AS BIGINT) for v in {x}], ',')"

_PER_TRACK = "SELECT track_uri, count(*) AS plays, sum(played_time)::BIGINT AS played_ms FROM t_plays GROUP BY track_uri"

_TOP = """
SELECT p.track_uri, any_value(t.title) AS track_title, count(*) AS plays,
       sum(p.played_time)::BIGINT AS played_ms
FROM t_plays p JOIN t_tracks t ON p.track_uri = t.uri
GROUP BY p.track_uri ORDER BY plays DESC, p.track_uri LIMIT {n}
"""

_FEATURES = [
    "valence", "energy", "danceability", "tempo", "acousticness", "instrumentalness",
    "liveness", "loudness", "speechiness",
]

_RULES = [
    ("tracks", "t_tracks", "title", "not_null", "title IS NULL"),
    ("tracks", "t_tracks", "uri", "max_length", "length(uri) > 255"),
    ("tracks", "t_tracks", "title", "max_length", "length(title) > 255"),
    ("tracks", "t_tracks", "album_name", "max_length", "length(album_name) > 255"),
    ("artists", "t_artists", "name", "not_null", "name IS NULL"),
    ("artists", "t_artists", "uri", "max_length", "length(uri) > 255"),
    ("artists", "t_artists", "name", "max_length", "length(name) > 255"),
    ("artists", "t_artists", "genres", "max_item_length",
     "len([g for g in genres if length(g) > 255]) > 0"),
    ("track_artists", "t_bridge", "track_uri", "not_null", "track_uri IS NULL"),
    ("track_artists", "t_bridge", "artist_uri", "not_null", "artist_uri IS NULL"),
    ("played_history", "t_plays", "played_at", "not_null", "played_at IS NULL"),
    ("played_history", "t_plays", "played_time", "not_null", "played_time IS NULL"),
    ("played_history", "t_plays", "track_uri", "max_length", "length(track_uri) > 255"),
    ("played_history", "t_plays", "context_type", "max_length", "length(context_type) > 50"),
    ("audio_features", "t_features", "track_uri", "not_null", "track_uri IS NULL"),
    ("embeddings", "t_vectors", "track_uri", "not_null", "track_uri IS NULL"),
    ("embeddings", "t_vectors", "embedding", "width", "len(embedding) <> 384"),
]

_REFERENCES = [
    ("track_artists", "t_bridge", "track_uri", "t_tracks"),
    ("track_artists", "t_bridge", "artist_uri", "t_artists"),
    ("played_history", "t_plays", "track_uri", "t_tracks"),
    ("audio_features", "t_features", "track_uri", "t_tracks"),
    ("embeddings", "t_vectors", "track_uri", "t_tracks"),
]


def oracle_sql() -> dict[str, str]:
    out = {}

    def star(name: str, body: str) -> None:
        out[name] = STAR + body

    def records(name: str, body: str) -> None:
        out[name] = RECORDS + body

    star("view_history", "SELECT * FROM v_listening_history")
    star("artist_names", "SELECT * FROM t_names")
    star("track_genres", "SELECT * FROM t_genres")
    star("join_plays_tracks",
         "SELECT id AS history_id, track_uri, title FROM t_plays JOIN t_tracks ON track_uri = uri")
    star("left_join_artists",
         "SELECT t.uri AS track_uri, b.artist_uri, a.name FROM t_tracks t "
         "LEFT JOIN t_bridge b ON t.uri = b.track_uri LEFT JOIN t_artists a ON b.artist_uri = a.uri")
    star("left_join_features",
         "SELECT t.uri AS track_uri, f.tempo, f.energy FROM t_tracks t "
         "LEFT JOIN t_features f ON t.uri = f.track_uri")
    star("unit_columns",
         "SELECT history_id, played_time_seconds, duration_seconds FROM v_listening_history")
    star("default_artist",
         "SELECT t.uri AS track_uri, coalesce(n.artist_names, 'Unknown Artist') AS artist_names "
         "FROM t_tracks t LEFT JOIN t_names n ON t.uri = n.track_uri")

    star("genre_filter",
         "SELECT history_id, track_uri, artist_genres FROM v_listening_history "
         "WHERE artist_genres ILIKE '%nation_1%'")
    star("date_range_events",
         "SELECT id, track_uri, played_at FROM t_plays WHERE played_at >= TIMESTAMP '2024-01-10' "
         "AND played_at < TIMESTAMP '2024-01-20'")
    star("listening_time",
         "SELECT artist_names, count(*) AS plays, sum(played_time)::BIGINT AS played_ms "
         "FROM v_listening_history GROUP BY artist_names")
    star("track_summary",
         "SELECT album_name, count(*) AS plays, count(DISTINCT track_uri) AS tracks, "
         "round(avg(tempo), 6) AS avg_tempo, min(energy) AS min_energy, max(valence) AS max_valence "
         "FROM v_listening_history GROUP BY album_name")
    star("plays_by_period",
         "SELECT date_trunc('day', played_at)::TIMESTAMP AS period, count(*) AS plays, "
         "sum(played_time)::BIGINT AS played_ms FROM v_listening_history GROUP BY 1")
    star("top_tracks", _TOP.format(n=25))
    star("rank_in_period",
         "SELECT period, track_uri, plays, rank() OVER (PARTITION BY period ORDER BY plays DESC) AS rank "
         "FROM (SELECT date_trunc('day', played_at)::TIMESTAMP AS period, track_uri, count(*) AS plays "
         "FROM t_plays WHERE track_uri IN (SELECT uri FROM t_tracks) GROUP BY 1, 2)")
    star("topn_by_period",
         f", top AS ({_TOP.format(n=10)}) "
         "SELECT p.track_uri, top.track_title, date_trunc('day', p.played_at)::TIMESTAMP AS period, "
         "count(*) AS plays, sum(p.played_time)::BIGINT AS played_ms "
         "FROM t_plays p JOIN top ON p.track_uri = top.track_uri GROUP BY 1, 2, 3")
    star("adhoc_sql",
         "SELECT track_uri, track_title, COUNT(*) AS plays, SUM(played_time)::BIGINT AS played_ms, "
         "MAX(tempo) AS tempo FROM v_listening_history WHERE artist_genres ILIKE '%asia%' "
         "AND played_at >= TIMESTAMP '2024-01-05' GROUP BY track_uri, track_title "
         "ORDER BY plays DESC, track_uri LIMIT 100")

    star("track_id",
         "SELECT uri, CASE WHEN starts_with(uri, 'spotify:track:') AND uri <> 'spotify:track:' "
         "AND NOT starts_with(uri, 'spotify:track:local:') THEN substr(uri, 15) END AS track_id "
         "FROM (SELECT uri FROM t_tracks UNION ALL SELECT uri FROM t_artists)")
    out["slug"] = (
        "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]', '_', 'g'), '_') AS slug "
        "FROM documents"
    )
    out["local_uri"] = _LOCAL_URI
    records("parse_ts", "SELECT event_id, played_at AS parsed FROM r_norm")
    star("embedding_text", _EMBEDDING_TEXT)
    out["cosine_distance"] = _CENTRES.format(by="label") + (
        f"SELECT vec_id, round({_DISTANCE}, 6) AS distance FROM embeddings JOIN centres ON label = g"
    )

    records("src_json_history",
            "SELECT stamp AS ts, given_uri AS track_uri, title, artist AS artist_name, "
            "album AS album_name, ms_played FROM r_typed")
    out["skipped_documents"] = """
      SELECT 'history-' || lpad(CAST(doc AS VARCHAR), 12, '0') || suffix AS file_name, skipped
      FROM (SELECT DISTINCT event_id // 1000 AS doc FROM events),
           (VALUES ('-cut.json', 'not_json'), ('-root.json', 'not_array')) AS v(suffix, skipped)
    """
    records("normalise_plays", "SELECT * FROM r_plays")
    records("rejected_plays",
            "SELECT file_name, pos, reason FROM r_checked WHERE reason IS NOT NULL")
    records("clamp_duration",
            "SELECT file_name, pos, CAST(CASE WHEN ms_played < 0 THEN 0 ELSE ms_played END AS INTEGER) "
            "AS playback_ms FROM r_typed")
    records("dim_tracks", "SELECT * FROM r_tracks")
    records("dim_artists", "SELECT * FROM r_artists")
    records("dim_track_artists", "SELECT * FROM r_pairs")
    for name in ("import_star", "import_twice", "stream_import"):
        records(name, _IMPORTED)
    records("default_stamps", f", imported AS ({_IMPORTED})" + """
      SELECT table_name, n, n AS stamped_by_first_load FROM imported WHERE table_name <> 'track_artists'
    """)
    half, per_track = "WHERE substr(file_name, 9, 12)::BIGINT % 2 = 0", """
      SELECT '{moment}' AS moment, track_uri, coalesce(artist_names, 'Unknown Artist') AS artist_names, plays
      FROM (SELECT track_uri, count(DISTINCT played_at) AS plays FROM r_plays {part} GROUP BY 1)
      LEFT JOIN (SELECT track_uri, string_agg(DISTINCT artist_name, ', ' ORDER BY artist_name) AS artist_names
                 FROM r_named {part} GROUP BY 1) USING (track_uri)
    """
    for name, opened, now in (("view_after_stream", half, ""), ("view_after_reset", "", half)):
        records(name, per_track.format(moment="opened", part=opened) + " UNION ALL "
                + per_track.format(moment="now", part=now))
    records("import_summary", """
      , source AS (SELECT DISTINCT 'spotify:track:' || (o_orderkey // 3) AS uri FROM orders)
      SELECT (SELECT count(*) FROM events) AS records_read,
             (SELECT count(*) FROM r_tracks) AS tracks, (SELECT count(*) FROM r_artists) AS artists,
             (SELECT count(*) FROM r_stored) AS plays,
             (SELECT count(*) FROM r_tracks) AS feature_candidates,
             (SELECT count(*) FROM r_tracks JOIN source USING (uri)) AS features_upserted,
             (SELECT count(*) FROM r_tracks) AS embedding_candidates,
             (SELECT count(*) FROM r_tracks) AS embeddings_upserted
    """)
    star("reset_reload", """
      SELECT 'tracks' AS table_name, count(*) AS n FROM t_tracks
      UNION ALL SELECT 'artists', count(*) FROM t_artists
      UNION ALL SELECT 'track_artists', count(*) FROM t_bridge
      UNION ALL SELECT 'played_history', 0
    """)

    out["upsert_nothing"] = """
      WITH items AS (
        SELECT 'spotify:track:' || l_partkey AS track_uri, l_shipdate AS played_at,
               CAST(floor(l_extendedprice) AS INTEGER) AS played_time, l_orderkey, l_linenumber,
               l_returnflag
        FROM lineitem
      ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY track_uri, played_at, l_returnflag = 'R'
                    ORDER BY l_orderkey, l_linenumber, played_time) AS n_own,
               row_number() OVER (PARTITION BY track_uri, played_at
                    ORDER BY l_orderkey, l_linenumber, played_time) AS n_all,
               bool_or(l_returnflag = 'R') OVER (PARTITION BY track_uri, played_at) AS stored
        FROM items
      )
      SELECT track_uri, played_at, played_time FROM ranked
      WHERE (stored AND l_returnflag = 'R' AND n_own = 1) OR (NOT stored AND n_all = 1)
    """
    merged = ", ".join(
        f"CASE WHEN s.id IS NOT NULL THEN s.{c} ELSE f.{c} END AS {c}" for c in _FEATURES
    )
    for name in ("upsert_features", "update_stored"):
        star(name,
             f"SELECT coalesce(f.track_uri, 'spotify:track:' || s.id) AS track_uri, {merged} "
             "FROM t_features f FULL JOIN t_source_one s ON f.track_uri = 'spotify:track:' || s.id")
    own, turned = _MICRO.format(x="embedding"), _MICRO.format(x="list_reverse(embedding)")
    out["upsert_embeddings"] = (
        f"SELECT CAST(vec_id AS VARCHAR) AS track_uri, CASE WHEN label < 5 THEN {turned} "
        f"ELSE {own} END AS embedding FROM embeddings "
        f"UNION ALL SELECT 'new-' || vec_id, {turned} FROM embeddings WHERE label >= 5"
    )
    star("play_ids", """
      , keys AS (SELECT DISTINCT track_uri, played_at FROM t_plays)
      SELECT 1000 + row_number() OVER (ORDER BY md5(track_uri || '|' || epoch_us(played_at)))
             AS id, track_uri, played_at FROM keys
    """)

    missing = "SELECT uri FROM t_tracks WHERE uri NOT IN (SELECT track_uri FROM t_features)"
    star("missing_features", missing)
    found = (
        f"SELECT m.uri AS track_uri, {', '.join(_FEATURES)} FROM ({missing}) m "
        "JOIN t_source_one s ON m.uri = 'spotify:track:' || s.id"
    )
    star("enrich_features", found)
    todo = "t_tracks t WHERE t.uri NOT IN (SELECT track_uri FROM t_vectors)"
    star("embedding_candidates",
         "SELECT t.uri AS track_uri, t.title, t.album_name, "
         "coalesce(n.artist_names, 'Unknown Artist') AS artist_names, f.tempo, f.energy, "
         "f.danceability, f.valence FROM t_tracks t LEFT JOIN t_names n ON n.track_uri = t.uri "
         "LEFT JOIN t_features f ON f.track_uri = t.uri "
         "WHERE t.uri NOT IN (SELECT track_uri FROM t_vectors)")
    star("enrichment_stats", f"""
      SELECT 'feature_candidates' AS statistic, count(*) AS n FROM ({missing})
      UNION ALL SELECT 'features_upserted', count(*) FROM ({found})
      UNION ALL SELECT 'embedding_candidates', count(*) FROM {todo}
      UNION ALL SELECT 'embeddings_upserted', count(*) FROM {todo}
    """)
    star("embed_batch",
         f"SELECT t.uri AS track_uri, 384 AS width, 1.0::DOUBLE AS length FROM {todo}")

    out["semantic_topk"] = STAR.replace("WITH", _CENTRES.format(by="1").rstrip() + ",", 1) + f"""
      , hits AS (
        SELECT track_uri, {_DISTANCE} AS distance FROM t_vectors JOIN centres ON g = 1
        WHERE track_uri IN (SELECT uri FROM t_tracks) ORDER BY distance, track_uri LIMIT 10
      )
      SELECT t.uri AS track_uri, t.title AS track, t.album_name AS album,
             coalesce((SELECT string_agg(DISTINCT name, '|' ORDER BY name) FROM t_bridge b
               JOIN t_artists a ON b.artist_uri = a.uri WHERE b.track_uri = t.uri), '') AS artists,
             coalesce(replace(g2.artist_genres, ', ', '|'), '') AS artist_genres,
             CAST(t.release_date AS VARCHAR) AS release_date, t.popularity,
             f.tempo, f.energy, f.danceability, f.valence,
             round(h.distance, 6) AS cosine_distance
      FROM hits h JOIN t_tracks t ON t.uri = h.track_uri
      LEFT JOIN t_genres g2 ON g2.track_uri = t.uri
      LEFT JOIN t_features f ON f.track_uri = t.uri
    """
    star("question_topk", f"""
      SELECT min(track_uri) AS track_uri, 0.0::DOUBLE AS cosine_distance FROM ({_EMBEDDING_TEXT}) HAVING count(*) > 0
    """)
    out["batch_topk"] = _CENTRES.format(by="label") + f"""
      , ranked AS (
        SELECT g AS query_id, 'spotify:track:' || vec_id AS track_uri,
               round({_DISTANCE}, 12) AS d
        FROM embeddings, centres
      )
      SELECT query_id::BIGINT AS query_id, track_uri, round(d, 6) AS cosine_distance,
             row_number() OVER (PARTITION BY query_id ORDER BY d, track_uri) AS rank
      FROM ranked QUALIFY rank <= 10
    """

    out["ann_topk"] = _CENTRES.format(by="1") + f"""
      , measured AS (
        SELECT 'spotify:track:' || vec_id AS track_uri, round({_DISTANCE}, 12) AS d FROM embeddings JOIN centres ON g = 1
      )
      SELECT track_uri, round(d, 6) AS cosine_distance FROM measured ORDER BY d, track_uri LIMIT 10
    """
    out["ann_recall"] = """
      SELECT count(*) AS queries, count(*) * least(10, (SELECT count(*) FROM embeddings)) AS found, true AS recall_reached
      FROM embeddings WHERE vec_id % 50 = 0
    """

    out["dq_unique"] = (
        "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem "
        "WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1"
    )
    keyed = [
        ("tracks", "t_tracks", "uri"),
        ("artists", "t_artists", "uri"),
        ("track_artists", "t_bridge", "track_uri, artist_uri"),
        ("played_history", "(SELECT 'spotify:track:' || l_partkey AS track_uri, l_shipdate AS played_at FROM lineitem)",
         "track_uri, played_at"),
        ("audio_features", "t_features", "track_uri"),
        ("embeddings", "t_vectors", "track_uri"),
    ]
    star("dq_unique_star", " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, count(*) AS n_keys, coalesce(sum(n), 0)::BIGINT AS n_rows, "
        f"count(*) FILTER (WHERE n > 1) AS n_repeated FROM (SELECT {keys}, count(*) AS n FROM {source} "
        f"WHERE {' AND '.join(k + ' IS NOT NULL' for k in keys.split(', '))} GROUP BY {keys})"
        for table, source, keys in keyed
    ))
    star("dq_columns", " UNION ALL ".join(
        f"SELECT '{column}' AS column_name, '{rule}' AS rule, "
        f"count(*) FILTER (WHERE {test}) AS violations, '{table}' AS table_name FROM {source}"
        for table, source, column, rule, test in _RULES
    ))
    star("dq_orphans", " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, {column} AS orphan_key, "
        f"count(*) AS n FROM {source} WHERE {column} NOT IN (SELECT uri FROM {parent}) GROUP BY 3"
        for table, source, column, parent in _REFERENCES
    ))
    kept = "track_uri NOT IN (SELECT uri FROM t_tracks WHERE album_name = 'Brand#1')"
    star("cascade_delete", f"""
      SELECT 'tracks' AS table_name, count(*) AS n FROM t_tracks
        WHERE album_name IS DISTINCT FROM 'Brand#1'
      UNION ALL SELECT 'artists', count(*) FROM t_artists
      UNION ALL SELECT 'track_artists', count(*) FROM t_bridge WHERE {kept}
      UNION ALL SELECT 'played_history', count(*) FROM t_plays WHERE {kept}
      UNION ALL SELECT 'audio_features', count(*) FROM t_features WHERE {kept}
      UNION ALL SELECT 'embeddings', count(*) FROM t_vectors WHERE {kept}
    """)

    out["sql_audit"] = _AUDIT
    star("rows_as_json", """
      SELECT '{"history_id":' || history_id || ',"track_uri":"' || track_uri
        || '","release_date":' || coalesce('"' || release_date || '"', 'null')
        || ',"played_time_seconds":"' || CAST(CAST(played_time AS DECIMAL(18, 3)) / 1000 AS DECIMAL(18, 3))
        || '","artist_genres":' || coalesce('"' || artist_genres || '"', 'null') || '}' AS json
      FROM v_listening_history
    """)
    out["drop_nested_keys"] = """
      SELECT event_id, '{"body":{"kind":"' || event_type || '","items":[{"value":' || value
        || '},{"value":' || value || '}]},"named":{"kept":{"value":' || value || '}},"open":{"list":[{"value":'
        || value || '},{"value":' || value || '}]}}' AS rest
      FROM events
    """
    return out
