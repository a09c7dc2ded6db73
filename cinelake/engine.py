"""The store: write a named video once, read any part of it in any shape, and keep the stored pieces in order."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.catalog import Catalog
from cinelake.functions.expressions import BITS_PER_PIXEL, file_name
from cinelake.operators import views
from cinelake.plans.arrayview import VideoArray
from cinelake.plans.planner import Format, Fragment, best_plan
from cinelake.session import checkpointed
from cinelake.sources import frames as fr
from cinelake.sources import mp4

#: Budget of a new video as a multiple of its size.
BUDGET_ENCODED, BUDGET_RAW = 10.0, 1.0
FPS = 30


class Store:
    """A store under ``path``: catalog/ and data/, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.catalog = Catalog(spark, f"{self.path}/catalog")

    # --- writing

    def write(self, name: str, frames: DataFrame, codec: str = "rgb", fps: int = FPS, gop_size: int | None = None, budget: float | None = None) -> int:
        """Stores ``frames`` under a new name and returns the physical video's id. ``gop_size`` frames go to a piece (30)."""
        logical = self._new(name)
        physical = self._store(logical, name, frames, codec, fps, gop_size or FPS, 0)
        self._first_budget(name, physical, codec, budget)
        return physical

    def _new(self, name: str) -> int:
        if self.exists(name):
            raise ValueError(f"there is a video named {name!r}")
        logical = self.catalog.next_id("logical_videos")
        self.catalog.append("logical_videos", self.spark.createDataFrame([(logical, name, 0.0)], "id long, name string, budget double"))
        return logical

    def _first_budget(self, name: str, physical: int, codec: str, budget: float | None) -> None:
        size = self.catalog.read("gops").where(F.col("physical_id") == physical).agg(F.sum("size")).first()[0] or 0
        self.set_budget(name, size * (budget or (BUDGET_RAW if codec == "rgb" else BUDGET_ENCODED)))

    def write_raw(self, name: str, path: str, resolution: tuple[int, int], fps: int = FPS, budget: float | None = None) -> int:
        return self.write(name, fr.read_raw(self.spark, path, *resolution, fps), "rgb", fps, budget=budget)

    def write_mp4(self, name: str, path: str, gop_size: int | None = None, budget: float | None = None) -> int:
        """Stores the video of an MP4 file as it is encoded: a piece for each group of pictures, decoded when it is read."""
        logical, physical = self._new(name), self.catalog.next_id("physical_videos")
        folder = f"data/{physical}"
        mp4.gop_rows(self.spark, path, gop_size).write.parquet(f"{self.path}/{folder}")
        rows = self.spark.read.parquet(f"{self.path}/{folder}")
        head = rows.select("codec", "height", "width", "fps", "n_frames").orderBy(F.desc("n_frames")).first()
        if head is None:
            raise ValueError(f"{path!r} has no samples")
        pieces = rows.select("gop", "first", "n_frames", F.octet_length("content").cast("long").alias("size"))
        self._add(logical, name, physical, folder, pieces, (head["height"], head["width"]), head["codec"], round(head["fps"]), head["n_frames"], 0)
        self._first_budget(name, physical, head["codec"], budget)
        return physical

    def _store(self, logical: int, name: str, frames: DataFrame, codec: str, fps: int, gop_size: int, offset_us: int, made_from: dict[int, tuple[float, int | None]] | None = None) -> int:
        """A physical video of ``frames``. ``made_from`` has for each of its GOPs the error to expect and the GOP that it was made from;
        without it the frames are an original, with no error."""
        physical = self.catalog.next_id("physical_videos")
        folder = f"data/{physical}"
        fr.encoded(frames.withColumn("video_id", F.lit(physical).cast("long")), codec, fps, gop_size).write.parquet(f"{self.path}/{folder}")
        pieces = self.spark.read.parquet(f"{self.path}/{folder}").select("gop", (F.col("gop") * gop_size).alias("first"), "n_frames", F.octet_length("content").cast("long").alias("size"))
        shape = frames.select("height", "width").first()
        height, width = (shape["height"], shape["width"]) if shape else (0, 0)
        self._add(logical, name, physical, folder, pieces, (height, width), codec, fps, gop_size, offset_us, made_from)
        return physical

    def _add(self, logical: int, name: str, physical: int, folder: str, pieces: DataFrame, shape: tuple[int, int], codec: str, fps: int, gop_size: int, offset_us: int, made_from: dict | None = None) -> None:
        """Catalog rows of a stored video. ``pieces`` has gop, first (frame), n_frames, size."""
        first_gop = self.catalog.next_id("gops")
        label = self.spark.range(1).select(file_name(F.lit(name), F.lit(physical), F.lit(codec))).first()[0]
        us = lambda frame: F.lit(offset_us) + F.expr(f"({frame}) * 1000000 div {fps}")
        origin = self.spark.createDataFrame([(k, float(error), parent) for k, (error, parent) in (made_from or {}).items()], "gop long, error double, parent long")
        gops = pieces.join(F.broadcast(origin), "gop", "left").select(  # a row for each GOP of one read
            (F.lit(first_gop) + F.col("gop")).alias("id"), F.lit(physical).alias("physical_id"), F.lit(label).alias("filename"), us("first").alias("start_us"), us("first + n_frames").alias("end_us"), F.col("gop").alias("piece"),
            F.lit(0).alias("start_byte"), F.col("size").alias("end_byte"), "size", F.lit(False).alias("joint"), F.lit(0).alias("examined"), F.lit(self.clock()).alias("clock"), F.lit(fps).alias("fps"),
            F.coalesce("error", F.lit(0.0)).alias("estimated_mse"), F.col("parent").alias("parent_id"),
        )
        row = [(physical, logical, *shape, codec, gop_size, label, folder)]
        physicals = self.spark.createDataFrame(row, "id long, logical_id long, height int, width int, codec string, gop_size int, filename string, folder string")
        self.catalog.write(
            physical_videos=self.catalog.read("physical_videos").unionByName(physicals, allowMissingColumns=True),
            gops=self.catalog.read("gops").unionByName(gops, allowMissingColumns=True),
        )

    def set_budget(self, name: str, budget: float) -> None:
        rows = self.catalog.read("logical_videos")
        self.catalog.write(logical_videos=rows.withColumn("budget", F.when(F.col("name") == name, F.lit(float(budget))).otherwise(F.col("budget"))))

    # --- reading

    def list(self) -> DataFrame:
        return self.catalog.read("logical_videos").select("name")

    def exists(self, name: str) -> bool:
        return not self.catalog.read("logical_videos").where(F.col("name") == name).isEmpty()

    def _logical(self, name: str) -> int:
        row = self.catalog.read("logical_videos").where(F.col("name") == name).first()
        if row is None:
            raise KeyError(f"there is no video named {name!r}")
        return row["id"]

    def _physicals(self, logical: int) -> DataFrame:
        return self.catalog.read("physical_videos").where(F.col("logical_id") == logical)

    def duration(self, name: str) -> float:
        gops = self.catalog.read("gops").join(self._physicals(self._logical(name)).select(F.col("id").alias("physical_id")), "physical_id", "left_semi")
        return (gops.agg(F.max("end_us")).first()[0] or 0) / 1e6

    def resolution(self, name: str) -> tuple[int, int]:
        row = self._physicals(self._logical(name)).orderBy("id").first()
        return row["height"], row["width"]

    def clock(self) -> int:
        """The next tick of the logical clock that orders reads."""
        return (self.catalog.read("gops").agg(F.max("clock")).first()[0] or 0) + 1

    def plan(self, name: str, resolution: tuple[int, int], t: tuple[float, float], codec: str) -> list[Fragment]:
        """The stored fragments that serve a read at the least cost, in order of time. Catalog rows of one video come to the driver."""
        physicals = {row["id"]: row for row in self._physicals(self._logical(name)).collect()}
        rows = self.catalog.read("gops").where(F.col("physical_id").isin(list(physicals))).select("id", "physical_id", "start_us", "end_us", "fps").collect() if physicals else []
        to_frame = lambda us: round(us * FPS / 1e6)
        first, last = round(t[0] * FPS), round(t[1] * FPS) - 1
        runs: dict[int, list[tuple[int, int, int]]] = {}
        for row in sorted(rows, key=lambda x: (x["physical_id"], x["start_us"], x["id"])):
            p = physicals[row["physical_id"]]
            low, high = to_frame(row["start_us"]), to_frame(row["end_us"]) - 1
            if low <= last and high >= first and p["height"] >= resolution[0] and p["width"] >= resolution[1]:
                runs.setdefault(row["physical_id"], []).append((row["id"], low, high))
        goal = Format(codec, *resolution)
        for own in runs.values():  # one stored video of the very format that covers all of it
            p = physicals[next(iter(k for k, v in runs.items() if v is own))]
            if Format(p["codec"], p["height"], p["width"]) == goal and own[0][1] <= first and own[-1][2] >= last and all(b[1] == a[2] + 1 for a, b in zip(own[:-1], own[1:], strict=True)):
                return [Fragment(p["id"], first, last, goal, tuple(own))]
        cuts = sorted({first, last + 1} | {x for own in runs.values() for _, low, high in own for x in (low, high + 1) if first < x <= last})
        choices = []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            options = []
            for video, own in sorted(runs.items()):
                touched = tuple(g for g in own if g[1] <= high - 1 and low <= g[2])
                if touched and touched[0][1] <= low and touched[-1][2] >= high - 1:
                    p = physicals[video]
                    options.append(Fragment(video, low, high - 1, Format(p["codec"], p["height"], p["width"]), touched))
            if not options:
                raise LookupError(f"{name!r} has no frames from {low / FPS} s to {high / FPS} s at {resolution[0]} x {resolution[1]} or more")
            choices.append(options)
        return best_plan(choices, goal)[1]

    def read(self, name: str, resolution: tuple[int, int] | None = None, roi: tuple[int, int, int, int] | None = None, t: tuple[float, float] | None = None, codec: str = "rgb", fps: float | None = None, materialize: bool = False) -> DataFrame:
        """Frames of a part of a video. ``roi`` is (y0, x0, y1, x1) at ``resolution``, which is the stored one by default.

        The plan is made from the catalog; the data read are the pieces that it names and no others. ``materialize`` stores the
        result as another physical video of the same name.
        """
        t, resolution = t or (0.0, self.duration(name)), resolution or self.resolution(name)
        plan = self.plan(name, resolution, t, codec)
        out, losses = None, None
        stamped: set[int] = set()
        for fragment in plan:
            stamped |= {g[0] for g in fragment.gops}
            part = self._pieces(fragment)
            if (fragment.format.height, fragment.format.width) != tuple(resolution):
                if materialize:
                    lost = fr.scale_error(part, *resolution)
                    losses = lost if losses is None else losses.unionByName(lost)
                part = fr.scale(part, *resolution)
            out = part if out is None else out.unionByName(part)
        if roi:
            out = fr.crop(out, *roi)
        first = round(t[0] * FPS)
        if fps and fps != FPS:
            out = fr.change_rate(out.withColumn("frame_no", F.col("frame_no") - first), FPS, fps).withColumn("t", F.col("t") + t[0])
        self.touch(stamped)
        if materialize and not roi and not (fps and fps != FPS):
            self._store(self._logical(name), name, out.withColumn("frame_no", F.col("frame_no") - first), codec, FPS, FPS, round(t[0] * 1e6), self._origins(plan, losses, first))
        return out

    def _origins(self, plan: list[Fragment], losses: DataFrame | None, first: int) -> dict[int, tuple[float, int | None]]:
        """For each GOP of a result the error to expect and the GOP that its first frame comes from. Of the GOPs that it is made from the
        worst counts; what scaling costs is measured."""
        measured = {}
        if losses is not None:
            gop = F.floor((F.col("frame_no") - first) / FPS).alias("gop")
            measured = {row["gop"]: row["mse"] for row in losses.groupBy(gop).agg(F.avg("mse").alias("mse")).collect()}  # a row for each GOP
        used = {g[0] for fragment in plan for g in fragment.gops}
        known = {row["id"]: row["error"] or 0.0 for row in self.catalog.read("gops").where(F.col("id").isin(list(used))).select("id", F.coalesce("mse", "estimated_mse").alias("error")).collect()}
        out: dict[int, tuple[float, int | None]] = {}
        for fragment in plan:
            for name, low, high in sorted(fragment.gops, key=lambda g: g[1]):
                for k in range((max(low, fragment.start) - first) // FPS, (min(high, fragment.end) - first) // FPS + 1):
                    worst, parent = out.get(k, (0.0, name))
                    out[k] = (max(worst, known[name]), parent)
        return {k: (2 * (worst + measured[k]) if measured.get(k) else worst, parent) for k, (worst, parent) in out.items()}

    def _pieces(self, fragment: Fragment) -> DataFrame:
        low, high = min(g[1] for g in fragment.gops), max(g[2] for g in fragment.gops)
        index = self.catalog.read("gops").where(F.col("id").isin([g[0] for g in fragment.gops])).select(F.col("piece").alias("gop"), "start_us", "zstandard")
        source = self.catalog.read("physical_videos").where(F.col("id") == fragment.video).select("folder").first()
        f = fragment.format
        files = self.spark.read.parquet(f"{self.path}/{source['folder']}").select("gop", "content").join(F.broadcast(index), "gop").select(  # the pieces of one plan
            F.lit(fragment.video).cast("long").alias("video_id"), F.lit(f.codec).alias("codec"), F.lit(f.height).alias("height"), F.lit(f.width).alias("width"), F.lit(float(FPS)).alias("fps"),
            F.round(F.col("start_us") * FPS / 1_000_000).cast("long").alias("first_frame"), "zstandard", "content",
        )
        low, high = max(low, fragment.start), min(high, fragment.end)
        return fr.decoded(files).where(F.col("frame_no").between(low, high))

    def touch(self, gop_ids: Iterable[int]) -> None:
        """Stamps GOPs as used now: a note in a log, whatever the size of the store."""
        if ids := list(gop_ids):
            self.catalog.used(ids, self.clock())

    def read_many(self, requests: list[dict]) -> DataFrame:
        """Frames of several reads as one plan, with ``request`` (its index)."""
        out = None
        for k, request in enumerate(requests):
            part = self.read(**request).withColumn("request", F.lit(k))
            out = part if out is None else out.unionByName(part)
        return out

    def load(self, name: str) -> VideoArray:
        return VideoArray.of(name, self.duration(name), *self.resolution(name), read=self.read)

    # --- removing

    def delete(self, name: str) -> None:
        logical = self._logical(name)
        physicals = self.catalog.read("physical_videos")
        gone = physicals.where(F.col("logical_id") == logical).select(F.col("id").alias("physical_id"))
        self.catalog.write(
            logical_videos=self.catalog.read("logical_videos").where(F.col("id") != logical), physical_videos=physicals.where(F.col("logical_id") != logical), gops=self.catalog.read("gops").join(gone, "physical_id", "left_anti")
        )

    def vacuum(self) -> None:
        """Drops physical videos without GOPs or whose folder is missing or has no pieces, and then folders that no video refers to."""
        physicals, gops = self.catalog.read("physical_videos"), self.catalog.read("gops")
        jvm = self.spark._jvm
        data = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        fs = data.getFileSystem(self.spark._jsc.hadoopConfiguration())
        there = [x.getPath() for x in fs.listStatus(data)] if fs.exists(data) else []
        full = [f"data/{x.getName()}" for x in there if any(y.getLen() > 0 and not y.getPath().getName().startswith(("_", ".")) for y in fs.listStatus(x))]
        known = F.broadcast(self.spark.createDataFrame([(x,) for x in full], "folder string"))  # a name for each stored video
        kept = physicals.join(known, "folder", "left_semi").select(*physicals.columns).join(gops.select(F.col("physical_id").alias("id")), "id", "left_semi").select(*physicals.columns)
        self.catalog.write(physical_videos=kept, gops=gops.join(kept.select(F.col("id").alias("physical_id")), "physical_id", "left_semi").select(*gops.columns))
        used = {row["folder"] for row in self.catalog.read("physical_videos").select("folder").distinct().collect()}
        for path in there:
            if f"data/{path.getName()}" not in used:
                fs.delete(path, True)

    # --- maintenance: each step is safe to repeat

    def compact(self) -> int:
        """Joins physical videos of one format that follow each other, as many at once as do not touch, until none do. Returns how many."""
        joined = 0
        while True:
            gops, physicals = self.catalog.read("gops"), self.catalog.read("physical_videos")
            # split parts of one stored video, or videos in folders of their own: only pieces of one folder can be one video
            folders = physicals.select("id", "folder")
            pairs = views.compaction_pairs(gops, physicals).join(folders.toDF("left_id", "f1"), "left_id").join(folders.toDF("right_id", "f2"), "right_id").withColumn("same", F.col("f1") == F.col("f2"))
            step = checkpointed(views.pairs_to_join(pairs).join(pairs.select("left_id", "right_id", "f1", "f2", "same"), ["left_id", "right_id"]))
            found = step.collect()  # a row for each video that ends where another one starts
            if not found:
                return joined
            for row in found:
                if not row["same"]:
                    self._merge(row["left_id"], row["right_id"], row["f1"], row["f2"])
            gops, physicals = self.catalog.read("gops"), self.catalog.read("physical_videos")
            gone = self.spark.createDataFrame([(row["right_id"],) for row in found], "id long")
            self.catalog.write(gops=views.compacted(gops, step.select("left_id", "right_id")), physical_videos=physicals.join(gone, "id", "left_anti").select(*physicals.columns))
            joined += len(found)

    def _merge(self, left: int, right: int, into: str, folder: str) -> None:
        """Writes the pieces of two videos to a new folder, numbered on."""
        gops, physicals = self.catalog.read("gops"), self.catalog.read("physical_videos")
        shift = (gops.join(physicals.where(F.col("folder") == into).select(F.col("id").alias("physical_id")), "physical_id", "left_semi").agg(F.max("piece")).first()[0] or 0) + 1
        new = f"data/{left}-{uuid.uuid4().hex[:8]}"
        one, two = (self.spark.read.parquet(f"{self.path}/{x}").select("gop", "n_frames", "content") for x in (into, folder))
        one.unionByName(two.withColumn("gop", F.col("gop") + shift)).write.parquet(f"{self.path}/{new}")
        moved = physicals.where(F.col("folder") == folder).select(F.col("id").alias("physical_id"), F.lit(True).alias("moved"))
        rows = gops.join(moved, "physical_id", "left").withColumn("piece", F.when(F.col("moved"), F.col("piece") + shift).otherwise(F.col("piece"))).select(*gops.columns)
        self.catalog.write(gops=rows, physical_videos=physicals.withColumn("folder", F.when(F.col("folder").isin(into, folder), F.lit(new)).otherwise(F.col("folder"))))

    def compress(self) -> int:
        """Compresses the raw pieces that storage pressure asks for, each by its level, and returns how many. A stored video is written to
        a new folder once for all its pieces; what is compressed already stays as it is."""
        gops, physicals, logicals = (self.catalog.read(x) for x in ("gops", "physical_videos", "logical_videos"))
        plain = gops.where("zstandard is null")
        levels = views.compression_candidates(plain, physicals, logicals).select("id", "level")
        todo = checkpointed(plain.join(levels, "id").join(physicals.select(F.col("id").alias("physical_id"), "folder"), "physical_id").select("id", "piece", "folder", "level"))
        done = todo.count()
        for row in todo.select("folder").distinct().collect():  # a row for each stored video over its budget
            new = f"data/{row['folder'].split('/')[1].split('-')[0]}-{uuid.uuid4().hex[:8]}"
            own = todo.where(F.col("folder") == row["folder"]).select(F.col("piece").alias("gop"), "level", "id")
            rows = self.spark.read.parquet(f"{self.path}/{row['folder']}").select("gop", "n_frames", "content").join(own.select("gop", "level"), "gop", "left")
            fr.compress_by(rows, "content", "level").drop("level").write.parquet(f"{self.path}/{new}")
            sizes = self.spark.read.parquet(f"{self.path}/{new}").select("gop", F.octet_length("content").cast("long").alias("new_size")).join(own, "gop")
            gops, physicals = self.catalog.read("gops"), self.catalog.read("physical_videos")
            changed = gops.join(sizes.select("id", "level", "new_size"), "id", "left")
            changed = changed.withColumns({"original_size": F.when(F.col("level").isNotNull(), F.col("size")).otherwise(F.col("original_size")), "zstandard": F.coalesce("level", "zstandard"), "size": F.coalesce("new_size", "size")})
            self.catalog.write(gops=changed.select(*gops.columns), physical_videos=physicals.withColumn("folder", F.when(F.col("folder") == row["folder"], F.lit(new)).otherwise(F.col("folder"))))
        return done

    def evict(self, policy: str = "weighted") -> list[int]:
        """Removes covered GOPs of videos over their budget, least valuable first, until all are within it or nothing is covered."""
        removed: list[int] = []
        while True:
            gops, physicals, logicals = (self.catalog.read(x) for x in ("gops", "physical_videos", "logical_videos"))
            over = views.storage_pressure(gops, physicals, logicals).where("pressure > 1").select("logical_id")
            ranks = views.gop_ranks(gops, physicals).join(over, "logical_id", "left_semi")
            found = views.evict_lru(ranks) if policy == "lru" else views.evict_candidates(ranks)
            victims = [row["id"] for row in found.select("id").collect()]  # one for each video over its budget
            if not victims:
                return removed
            keep = views.evicted(gops, self.spark.createDataFrame([(x,) for x in victims], "id long"))
            new = keep.where("physical_id < 0").select(F.col("physical_id").alias("id")).distinct().collect()
            number = self.catalog.next_id("physical_videos")
            for k, row in enumerate(sorted(new)):
                old = gops.where(F.col("id") == -row["id"]).select("physical_id").first()[0]
                source = physicals.where(F.col("id") == old).withColumn("id", F.lit(number + k).cast("long"))
                physicals = physicals.unionByName(source)
                keep = keep.withColumn("physical_id", F.when(F.col("physical_id") == row["id"], F.lit(number + k)).otherwise(F.col("physical_id")))
            physicals = physicals.join(keep.select(F.col("physical_id").alias("id")), "id", "left_semi")
            self.catalog.write(gops=keep, physical_videos=physicals)
            removed += victims

    def verify_quality(self) -> None:
        """Sets the error of GOPs whose exact error is unknown to the sum along their line of parents."""
        gops = self.catalog.read("gops")
        line = views.lineage_error(gops).select("id", "error")
        self.catalog.write(gops=gops.join(line, "id").withColumn("mse", F.coalesce("mse", "error")).drop("error"))


def raw_gop_size(n_bytes: int, height: int, width: int) -> int:
    """Whole frames in a raw file."""
    return n_bytes // (height * width * BITS_PER_PIXEL["rgb"] // 8)
