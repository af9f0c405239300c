"""Times, frame counts and geometry of recordings as column expressions. Decoding pictures is the business of a source;
what is here works on their metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fraction(text: Column) -> Column:
    """'30000/1001' or '25' as a double; null for '0/0', 'N/A' and whatever is no number."""
    parts = F.split(F.trim(text), "/")
    top, low = F.get(parts, 0).try_cast("double"), F.when(F.size(parts) > 1, F.get(parts, 1).try_cast("double")).otherwise(F.lit(1.0))
    return F.try_divide(top, F.nullif(low, F.lit(0.0)))


def timeline(last_time: Column, fps: float, longest: float) -> Column:
    """array<double> of times i / fps from 0 to at most min(last_time, longest), inclusive; null if there are fewer than two."""
    count = F.floor(F.least(last_time, F.lit(longest)) * fps + 1e-9).cast("int") + 1
    return F.when(count >= 2, F.transform(F.sequence(F.lit(0), count - 1), lambda i: i / F.lit(fps)))


def fixed_timeline(duration: float, fps: float) -> Column:
    """round(duration x fps) + 1 times."""
    return F.transform(F.sequence(F.lit(0), F.lit(round(duration * fps))), lambda i: i / F.lit(fps))


def nearest_index(time: Column, fps: Column) -> Column:
    """The frame nearest to a time; halves go to the even one."""
    return F.rint(time * fps).cast("int")


def sampling_fault(fps: Column, frame_count: Column, last_wanted: Column, least_fps: float = 8.0, tolerance: float = 0.02) -> Column:
    """Why a recording can't be sampled up to a time, null if it can."""
    last = F.try_divide(frame_count - 1, fps)
    return (
        F.when(F.coalesce(fps <= 0, F.lit(True)) | F.coalesce(frame_count < 1, F.lit(True)), "invalid_video_metadata").when(fps < least_fps, "source_fps_too_low")
        .when((last + tolerance < last_wanted) | (F.rint(last_wanted * fps) >= frame_count), "insufficient_duration"))


def letterbox(width: Column, height: Column, target_width: int, target_height: int) -> Column:
    """struct<scale, width, height, left, top>: how a picture fits into a frame, its proportions kept."""
    scale = F.least(F.lit(float(target_width)) / width, F.lit(float(target_height)) / height)
    w, h = F.greatest(F.lit(1), F.rint(width * scale).cast("int")), F.greatest(F.lit(1), F.rint(height * scale).cast("int"))
    half = lambda total, part: F.floor((F.lit(total) - part) / 2).cast("int")
    return F.struct(scale.alias("scale"), w.alias("width"), h.alias("height"), half(target_width, w).alias("left"), half(target_height, h).alias("top"))


def frame_count(duration: Column, speed: Column, fps: float, most: int, least: int) -> Column:
    """Frames of a clip slowed to physical speed: at most `most`, of the form 4n + 1; null if fewer than `least`."""
    raw = F.least(F.floor(duration / speed * fps + 1e-6).cast("int"), F.lit(most))
    fitted = raw - F.pmod(raw - 1, F.lit(4))
    return F.when(fitted >= least, fitted)


def speed_factor(value: Column) -> Column:
    """1 where none is given; null where it isn't above 0."""
    v = F.coalesce(value, F.lit(1.0))
    return F.when(v > 0, v)


def scale_filter(width: int, height: int, pad_colour: str = "black") -> str:
    """The text of a scale-and-pad filter."""
    # Fixed value: the filter text of the media tool.
    return f"scale={width}:{height}:force_original_aspect_ratio=decrease,pad={width}:{height}:(ow-iw)/2:(oh-ih)/2:color={pad_colour},setsar=1"


def bucket(scene: Column, buckets: dict[str, tuple[int, int, tuple[str, ...]]]) -> Column:
    """struct<name, width, height> of the size class of a scene; null for a scene in none. buckets: name -> (width, height,
    scenes). A scene in two classes, or a side that is no multiple of 16, is an error."""
    of_scene: dict[str, str] = {}
    for name, (width, height, scenes) in sorted(buckets.items()):
        if width % 16 or height % 16:
            raise ValueError(f"{name}: {width}x{height} is no multiple of 16")
        for s in scenes:
            if s in of_scene:
                raise ValueError(f"{s} is in several size classes")
            of_scene[s] = name
    out = F.lit(None).cast("struct<name: string, width: int, height: int>")
    for name, (width, height, scenes) in sorted(buckets.items()):
        out = F.when(scene.isin(*scenes), F.struct(F.lit(name).alias("name"), F.lit(width).alias("width"), F.lit(height).alias("height"))).otherwise(out)
    return out


def max_pixels(buckets: dict[str, tuple[int, int, tuple[str, ...]]]) -> int:
    """Pixels of the largest size class."""
    return max(width * height for width, height, _ in buckets.values())


def media_path(path: Column, home: str, cache: str | None = None, run: str | None = None, name: Column | None = None) -> Column:
    """Where a recording lies: absolute paths as they are, relative ones under the manifest's folder. With a name, where its
    derivative goes: into the cache if there is one, else into the run's folder."""
    if name is not None:
        root = cache or (f"{run}/media" if run else None)
        if root is None:
            raise ValueError("a derivative needs a cache or a run")
        return F.concat(F.lit(root.rstrip("/") + "/"), name)
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(home.rstrip("/") + "/"), path))


def adapter_media(config: dict) -> dict:
    """The media settings of an adapter's configuration document: sizes by class, frame rate, frame limits and pad colour."""
    spatial, temporal = config["spatial"], config["temporal"]
    held = spatial.get("aspect_ratio_buckets", {})
    whole = {"default": (int(spatial["width"]), int(spatial["height"]), ())}
    buckets = {k: (int(b["width"]), int(b["height"]), tuple(b.get("scene_ids", ()))) for k, b in held.get("buckets", {}).items()} if held.get("enabled") else whole
    if not buckets:
        raise ValueError("size classes are asked for, but there are none")
    least, most = int(temporal.get("min_frames", 5)), int(temporal["max_frames"])
    if least % 4 != 1 or most % 4 != 1 or least > most:
        raise ValueError("frame limits must be 4n + 1, the least not above the most")
    return {"buckets": buckets, "fps": int(temporal["fps"]), "min_frames": least, "max_frames": most, "pad_colour": str(spatial.get("pad_color", "black")), "max_pixels": max_pixels(buckets)}
