"""The star schema as Parquet tables below one folder."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklore.operators.upsert import insert_or_update, stamp
from tracklore.plans.history_view import track_profile
from tracklore.schema import TABLE_SCHEMAS, UNIQUE_KEYS, WRITE_ORDER, Star
from tracklore.session import stage
from tracklore.sources.manifests import EMPTY, Manifests

# Upper bound on rows per file, in place of fixed-size insert batches.
MAX_RECORDS_PER_FILE = 50_000_000
MONTH = "played_month"
COMMIT = "commit"
PROFILE = "track_profile"
# Tables that the profile is made of.
PROFILE_TABLES = ["tracks", "artists", "track_artists", "audio_features"]
# Changes of the profile, or updates of a table, that a reader puts over the rest, before
# they are written together.
MAX_DELTAS = 8
# Updates of more than this share of a table's rows are written into it.
MAX_UPDATED = 0.25
KEEP_SECONDS = 24 * 3600


def month_of(played_at: str):
    return F.date_format(played_at, "yyyy-MM")


def put_over(rows: DataFrame, newer: DataFrame, key: str = "track_uri") -> DataFrame:
    """``rows`` with those of ``newer`` in place of the ones of the same track."""
    return rows.join(newer.select(key), key, "left_anti").unionByName(newer)


def _updates(state: dict, name: str) -> list[str]:
    return state.get("updates", {}).get(name, [])


def _with(state: dict, name: str, commits: list[str], updates: list[str]) -> dict:
    """The state with other commits and updates of one table."""
    return {
        **state,
        "tables": {**state["tables"], name: commits},
        "updates": {**state.get("updates", {}), name: updates},
    }


@dataclass(frozen=True)
class Snapshot:
    """The tables as of one commit. Later commits, a reset too, leave its files alone."""

    warehouse: Warehouse
    number: int
    state: dict

    def commits(self, name: str) -> list[str]:
        return self.state["tables"].get(name, [])

    def updates(self, name: str) -> list[str]:
        return _updates(self.state, name)

    def read(self, name: str) -> DataFrame:
        """A table; empty when nothing has been written. Plays carry their month.

        Rows that were only added have keys of their own, so updates, the newest first,
        stand for all rows of their keys.
        """
        rows = self.warehouse.read_commits(name, self.commits(name))
        changed = self.read_updates(name)
        return rows if changed is None else put_over(rows, changed, *UNIQUE_KEYS[name])

    def read_updates(self, name: str) -> DataFrame | None:
        """The updated rows of a table, one per key."""
        changed = None
        for commit in self.updates(name):
            newer = self.warehouse.read_commits(name, [commit])
            changed = newer if changed is None else put_over(changed, newer, *UNIQUE_KEYS[name])
        return changed

    def star(self) -> Star:
        return Star(**{name: self.read(name).drop(MONTH) for name in WRITE_ORDER})

    def _changed_tracks(self) -> DataFrame | None:
        """Tracks whose profile the stored one does not know, by what was added since.

        None when a table was replaced since, so that any track may have changed.
        """
        known, parts = self.state["profile"]["tables"], {}
        for name in PROFILE_TABLES:
            old, now = known[name], self.commits(name)
            seen, updated = _updates(self.state["profile"], name), self.updates(name)
            if now[: len(old)] != old or updated[: len(seen)] != seen:
                return None
            parts[name] = self.warehouse.read_commits(name, now[len(old) :] + updated[len(seen) :])
        by_artist = self.read("track_artists").join(
            parts["artists"].select(F.col("uri").alias("artist_uri")), "artist_uri", "left_semi"
        )
        return (
            parts["tracks"].select(F.col("uri").alias("track_uri"))
            .union(parts["track_artists"].select("track_uri"))
            .union(parts["audio_features"].select("track_uri"))
            .union(by_artist.select("track_uri"))
            .distinct()
        )

    def profile_is_current(self) -> bool:
        stored = self.state["profile"]
        return stored is not None and all(
            stored["tables"][n] == self.commits(n) and _updates(stored, n) == self.updates(n) for n in PROFILE_TABLES
        )

    def stored_profile(self) -> DataFrame:
        stored = self.state["profile"]
        rows = self.warehouse.read_commits(PROFILE, stored["base"])
        for change in stored["changes"]:
            rows = put_over(rows, self.warehouse.read_commits(PROFILE, [change]))
        return rows

    def changed_profile(self) -> DataFrame | None:
        """Profile rows of the tracks that changed since it was stored: only their credits
        and features are joined. None when it must be built anew."""
        changed = self._changed_tracks() if self.state["profile"] else None
        if changed is None:
            return None
        star = self.star()
        own = {name: star[name].join(changed, "track_uri", "left_semi") for name in ("track_artists", "audio_features")}
        tracks = star.tracks.join(changed.withColumnRenamed("track_uri", "uri"), "uri", "left_semi")
        return track_profile(Star(**{**dict(star.items()), **own, "tracks": tracks}))

    def profile(self) -> DataFrame | None:
        """The per-track columns of the view, from the stored ones where there are any; None
        when they were never stored or a table behind them was replaced."""
        if self.profile_is_current():
            return self.stored_profile()
        newer = self.changed_profile()
        return None if newer is None else put_over(self.stored_profile(), newer)


class Warehouse:
    """Tables are sets of commits, folders that are written once; plays are laid out by
    month below. Which commits a table has is said by the latest manifest, so a writer
    adds its rows all at once, and a reader keeps what it has opened."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._manifests = Manifests(spark, f"{self.root}/manifests")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _target(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def snapshot(self) -> Snapshot:
        return Snapshot(self, *self._manifests.latest())

    def version(self) -> int:
        """Number of the latest commit."""
        known = self._manifests.listed()
        return known[-1][0] if known else 0

    def read_commits(self, name: str, commits: list[str]) -> DataFrame:
        if name == PROFILE:
            schema = track_profile(Star(**{n: self.read_commits(n, []) for n in WRITE_ORDER})).schema
        else:
            text = TABLE_SCHEMAS[name] + (f", {MONTH} string" if name == "played_history" else "")
            schema = T.StructType.fromDDL(text)
        if not commits:
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        paths = [f"{self.path(name)}/{COMMIT}={c}" for c in commits]
        return self.spark.read.schema(schema).option("basePath", self.path(name)).parquet(*paths).drop(COMMIT)

    def read(self, name: str) -> DataFrame:
        return self.snapshot().read(name)

    def star(self) -> Star:
        return self.snapshot().star()

    def _store(self, name: str, rows: DataFrame) -> str:
        """Write rows as a commit that no table has yet; columns they lack are NULL."""
        commit = f"c{uuid.uuid4().hex}"
        out = rows
        if name != PROFILE:
            fields = T.StructType.fromDDL(TABLE_SCHEMAS[name]).fields
            out = rows.select(
                *[
                    (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                    for f in fields
                ]
            )
        if name == "played_history":
            # Rebalancing sends each month to few files and splits a month that is
            # larger than the advisory partition size.
            out = out.withColumn(MONTH, month_of("played_at")).hint("rebalance", MONTH)
        writer = out.write.option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        if name == "played_history":
            writer = writer.partitionBy(MONTH)
        writer.parquet(f"{self.path(name)}/{COMMIT}={commit}")
        return commit

    def _drop(self, name: str, commit: str) -> None:
        target, files = self._target(f"{self.path(name)}/{COMMIT}={commit}")
        files.delete(target, True)

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows; columns the rows lack are stored as NULL."""
        commit = self._store(name, rows)
        self._manifests.commit(lambda s: _with(s, name, [*s["tables"].get(name, []), commit], _updates(s, name)))

    def _change(self, name: str, made: Callable[[Snapshot], DataFrame | None], place: Callable) -> None:
        """Store the rows that ``made`` makes from the stored ones, if any, as ``place`` says
        from commits, updates and the new commit.

        When another writer changes the table meanwhile, the rows are made again from what
        is stored then, so no key comes in twice and no update is lost.
        """
        while True:
            at = self.snapshot()
            rows = made(at)
            if rows is None:
                return
            commit, known, updated = self._store(name, rows), at.commits(name), at.updates(name)

            def add(state):
                if state["tables"].get(name, []) != known or _updates(state, name) != updated:
                    return None
                return _with(state, name, *place(known, updated, commit))

            if self._manifests.commit(add) is not None:
                return
            self._drop(name, commit)

    def insert(self, name: str, fresh: Callable[[DataFrame], DataFrame | None]) -> None:
        """Add the rows that ``fresh`` makes from the stored ones, if any."""
        self._change(
            name, lambda at: fresh(at.read(name)), lambda known, updated, new: ([*known, new], updated)
        )

    def update(self, name: str, incoming: DataFrame, columns: Sequence[str]) -> None:
        """Take ``columns`` from ``incoming`` where a key is stored, and add its other rows.

        Only the rows of incoming keys are written; readers put them over the rest. Stored
        rows are looked for between the smallest and the largest incoming key. A table with
        many updates has them written together, or into it once they are a good part of it.
        Rows without a key are left out; of several for one key the largest is taken.
        """
        if len(UNIQUE_KEYS[name]) > 1:
            raise ValueError(f"{name} has a key of several columns and takes inserts only")
        (key,) = UNIQUE_KEYS[name]
        others = [c for c in incoming.columns if c != key]
        if not others:
            raise ValueError("an update needs a column beside the key")
        one = incoming.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*others)).alias("_row"))
        sent = stage(one.select(key, *[F.col("_row")[c].alias(c) for c in others]), "sent")
        low, high = sent.agg(F.min(key), F.max(key)).first()
        if low is None:
            return
        if "updated_at" not in others:
            sent = stamp(sent, "updated_at")

        def merged(at: Snapshot) -> DataFrame:
            near = at.read(name).filter(F.col(key).between(low, high))
            return insert_or_update(near.join(sent.select(key), key, "left_semi"), sent, key, columns)

        self._change(name, merged, lambda known, updated, new: (known, [*updated, new]))
        self._settle(name)

    def _settle(self, name: str) -> None:
        """Write many updates together, or all of the table once they are a good part of it."""
        at = self.snapshot()
        if not at.updates(name):
            return
        changed = self.read_commits(name, at.updates(name)).count()
        if changed > MAX_UPDATED * self.read_commits(name, at.commits(name)).count():
            self.compact(name)
        elif len(at.updates(name)) > MAX_DELTAS:
            commit, known = self._store(name, at.read_updates(name)), at.updates(name)

            def swap(state):
                now = _updates(state, name)
                if now[: len(known)] != known:
                    return None
                profile = state["profile"]
                if profile and name in profile["tables"]:
                    seen = _updates(profile, name)
                    # A profile that knows a part of them takes all as changes again.
                    seen = [commit, *seen[len(known) :]] if seen[: len(known)] == known else []
                    profile = _with(profile, name, profile["tables"][name], seen)
                state = {**state, "profile": profile}
                return _with(state, name, state["tables"].get(name, []), [commit, *now[len(known) :]])

            if self._manifests.commit(swap) is None:
                self._drop(name, commit)

    def overwrite(self, name: str, rows: DataFrame) -> None:
        """Replace a table, also by a result computed from it."""
        commit = self._store(name, rows)
        self._manifests.commit(lambda s: _with(s, name, [commit], []))

    def reset(self) -> None:
        """Empty every table and restart ids."""
        self._manifests.commit(lambda _: dict(EMPTY))

    def last_play_id(self) -> int:
        return self.snapshot().state["last_play_id"]

    def reserve_play_ids(self, count: int) -> int:
        """Set ``count`` ids aside and return the last one used before; each writer gets a
        range of its own. A failed import leaves a gap, never a repeated id."""
        state = self._manifests.commit(lambda s: {**s, "last_play_id": s["last_play_id"] + count})
        return state["last_play_id"] - count

    def profile(self) -> DataFrame | None:
        return self.snapshot().profile()

    def refresh_profile(self) -> None:
        """Store the per-track columns of the view, so that queries join plays once.

        Only tracks that changed since the last time are worked out and written; every
        ``MAX_DELTAS`` times all is written together.
        """
        at = self.snapshot()
        if at.profile_is_current():
            return
        made = {
            "tables": {name: at.commits(name) for name in PROFILE_TABLES},
            "updates": {name: at.updates(name) for name in PROFILE_TABLES},
            "changes": [],
        }
        newer = at.changed_profile()
        if newer is None:
            made["base"] = [self._store(PROFILE, track_profile(at.star()))]
        elif len(at.state["profile"]["changes"]) < MAX_DELTAS:
            stored = at.state["profile"]
            made["base"], made["changes"] = stored["base"], [*stored["changes"], self._store(PROFILE, newer)]
        else:
            made["base"] = [self._store(PROFILE, put_over(at.stored_profile(), newer))]
        # Of two writers the later one stands; what it does not know yet is worked out by readers.
        self._manifests.commit(lambda s: {**s, "profile": made})

    def compact(self, name: str) -> None:
        """Write a table's commits together, and its updates into them, so that readers list
        and open fewer files. Rows are laid out by key, so that an update can skip files."""
        at = self.snapshot()
        known, updated = at.commits(name), at.updates(name)
        if len(known) < 2 and not updated:
            return
        rows = at.read(name)
        if name != "played_history":
            rows = rows.repartitionByRange(*UNIQUE_KEYS[name]).sortWithinPartitions(*UNIQUE_KEYS[name])
        commit = self._store(name, rows)

        def swap(state):
            now, newer = state["tables"].get(name, []), _updates(state, name)
            if now[: len(known)] != known or newer[: len(updated)] != updated:
                return None
            profile = state["profile"]
            if profile and name in profile["tables"]:
                old, seen = profile["tables"][name], _updates(profile, name)
                if old[: len(known)] == known and seen[: len(updated)] == updated:
                    profile = _with(profile, name, [commit, *old[len(known) :]], seen[len(updated) :])
                else:
                    profile = None
            return _with({**state, "profile": profile}, name, [commit, *now[len(known) :]], newer[len(updated) :])

        if self._manifests.commit(swap) is None:
            self._drop(name, commit)

    def vacuum(self, keep_seconds: float = KEEP_SECONDS) -> None:
        """Delete what no manifest of the last ``keep_seconds`` names; a view that was
        opened before may then lose its files."""
        limit = (time.time() - keep_seconds) * 1000
        known = self._manifests.listed()
        kept = [n for k, (n, at) in enumerate(known) if at >= limit or k + 1 == len(known)]
        # The state a kept one followed was current within the time too.
        kept = [n for n, _ in known if n >= min(kept, default=0) - 1]
        used = set()
        for number in kept:
            state = self._manifests.state(number)
            profile = state["profile"] or {"base": [], "changes": []}
            used |= {(PROFILE, c) for c in [*profile["base"], *profile["changes"]]}
            for tables in (state["tables"], state.get("updates", {})):
                used |= {(name, c) for name, commits in tables.items() for c in commits}
        for name in [*WRITE_ORDER, PROFILE]:
            target, files = self._target(self.path(name))
            for f in files.listStatus(target) if files.exists(target) else []:
                commit = f.getPath().getName().partition("=")[2]
                if commit and (name, commit) not in used and f.getModificationTime() < limit:
                    files.delete(f.getPath(), True)
        for number, _ in known:
            if number not in kept:
                self._manifests.forget(number)
