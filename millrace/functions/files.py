"""Column functions over file rows: what a file is, what it may become, and how that is shown.

All of them are built-in expressions, so they stay inside generated code and reach pushed filters
where Spark can push them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as v
from .text import fixed, last_dot, round_half_up

KB, MB, GB = 1 << 10, 1 << 20, 1 << 30


def _lower(x: Column) -> Column:
    return F.lower(F.coalesce(x, F.lit("")))


def ext_of(name: Column) -> Column:
    """Lower-case extension with its dot, from the last dot; empty if there is none."""
    n = _lower(name)
    dot = last_dot(n)
    return F.when(dot > 0, n.substr(dot, F.length(n))).otherwise("")


def src_ext(name: Column) -> Column:
    """Extension as a label; PNG stands in."""
    e = F.upper(F.substring(ext_of(name), 2, 1 << 20))
    return F.when(F.length(e) > 0, e).otherwise("PNG")


def _ends(name: Column, exts: Sequence[str]) -> Column:
    out = F.lit(False)
    for e in exts:
        out = out | F.endswith(name, F.lit(e))
    return out


def _is(family: str, name: Column, kind: Column) -> Column:
    return kind.isin(v.TYPES[family]) | _ends(name, v.EXTS[family])


def is_supported(name: Column, kind: Column) -> Column:
    """A media type or an extension of any family."""
    n, t = _lower(name), _lower(kind)
    out = F.lit(False)
    for family in v.TYPES:
        out = out | _is(family, n, t)
    return out


def stub_kind(name: Column) -> Column:
    """Family of a format that is known but not converted."""
    return F.when(ext_of(name).isin(v.STUB_EXTS), "image").otherwise("")


def family_of(name: Column, kind: Column) -> Column:
    """image, audio, document, video, or empty."""
    n, t, e = _lower(name), _lower(kind), ext_of(name)
    out = F.when(e.isin(".gif", ".avif") | t.isin("image/gif", "image/avif"), "")
    for family in v.TYPES:
        out = out.when(_is(family, n, t), family)
    out = out.when(e.isin(v.STUB_EXTS), "image")
    for family in ("image", "audio", "video"):
        out = out.when(F.startswith(t, F.lit(f"{family}/")), family)
    return out.otherwise("")


def is_known(name: Column, kind: Column) -> Column:
    return family_of(name, kind) != ""


def convertible(family: Column, target: Column) -> Column:
    """The target is one of the family's."""
    out = F.lit(False)
    for f, ts in v.TARGETS.items():
        out = out | ((family == f) & target.isin(ts))
    return F.coalesce(out, F.lit(False))


def default_target(family: Column, wanted: Column) -> Column:
    """The wanted target if the family has it, else the family's own; documents become PDF in any case."""
    out = F.when(family == "document", "PDF")
    for f in ("image", "audio", "video"):
        out = out.when(family == f, F.when(wanted.isin(v.TARGETS[f]), wanted).otherwise(v.DEFAULT_TARGET[f]))
    return out.otherwise(wanted)


def entry_target(family: Column, wanted: Column, supported: Sequence[str]) -> Column:
    """default_target(), repaired where the target cannot be made here."""
    first = default_target(family, wanted)
    able = first.isin(list(supported))
    out = F.when(~F.coalesce(able, F.lit(False)) & (family == "image") & (first == "WEBP"), "JPG")
    out = out.when(~F.coalesce(able, F.lit(False)) & (family == "audio"), F.lit("MP3" if "MP3" in supported else "WAV"))
    out = out.when(~F.coalesce(able, F.lit(False)) & (family == "document"), F.lit("PDF" if "PDF" in supported else "TXT"))
    video = next((t for t in ("MP4", "WEBM") if t in supported), None)
    if video:
        out = out.when(~F.coalesce(able, F.lit(False)) & (family == "video"), F.lit(video))
    return out.otherwise(first)


def limit_bytes(family: Column, mobile: bool = False) -> Column:
    return F.when(family == "video", F.lit(v.MAX_BYTES_VIDEO_MOBILE if mobile else v.MAX_BYTES_VIDEO)).otherwise(F.lit(v.MAX_BYTES)).cast("long")


def fmt_size(n: Column) -> Column:
    """Bytes as B, KB, MB (one decimal) or GB (two)."""
    n = F.coalesce(n, F.lit(0)).cast("long")
    return (
        F.when(n < KB, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < MB, F.concat(fixed(n, KB, 1), F.lit(" KB")))
        .when(n < GB, F.concat(fixed(n, MB, 1), F.lit(" MB")))
        .otherwise(F.concat(fixed(n, GB, 2), F.lit(" GB")))
    )


def fmt_kb(kb: Column) -> Column:
    tenths = F.floor(kb / 1024.0 * 10.0 + 0.5).cast("long")
    whole = ((tenths - F.pmod(tenths, F.lit(10))) / F.lit(10)).cast("long")
    return F.when(kb >= 1024, F.concat(whole.cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit(" MB"))).otherwise(F.concat(round_half_up(kb).cast("string"), F.lit(" KB")))


def short_name(name: Column, most: int = 24) -> Column:
    """A long name as its beginning, an ellipsis and its extension."""
    most = max(8, most)
    n = F.coalesce(name, F.lit(""))
    dot = last_dot(n)
    ext = F.when(dot > 1, n.substr(dot, F.length(n))).otherwise("")
    keep = F.greatest(F.lit(1), F.lit(most - 1) - F.length(ext))
    return F.when(F.length(n) <= most, n).otherwise(F.concat(n.substr(F.lit(1), keep), F.lit("…"), ext))


def ext_for(family: Column, target: Column) -> Column:
    """Extension of a target without its dot."""
    t = F.lower(F.coalesce(target, F.lit("")))
    known = {f: [x.lower() for x in ts] for f, ts in v.TARGETS.items()}
    return (
        F.when(family == "audio", F.when(t.isin(known["audio"]), t).otherwise("mp3"))
        .when(family == "video", F.when(t.isin(known["video"]), t).otherwise("mp4"))
        .when(family == "document", F.when(t.isin(known["document"]), t).otherwise("txt"))
        .otherwise(t)
    )


def out_name(name: Column, family: Column, target: Column) -> Column:
    stem = F.regexp_replace(F.coalesce(name, F.lit("converted")), r"(?i)\.[a-z0-9]+$", "")
    return F.concat(F.when(F.length(stem) > 0, stem).otherwise("converted"), F.lit("."), ext_for(family, target))


def clamp_quality(q: Column) -> Column:
    """1 to 100; nothing and 0 count as the default."""
    q = F.when(q.isNull() | (q == 0), F.lit(v.DEFAULT_QUALITY)).otherwise(q)
    return F.least(F.lit(100), F.greatest(F.lit(1), q)).cast("double")


def bitrate(q: Column, target: Column) -> Column:
    """Nearest standard bitrate, the lower of two; null for lossless targets."""
    raw = F.lit(64) + clamp_quality(q) / 100 * 256
    steps = F.array(*(F.struct(F.abs(F.lit(float(b)) - raw).alias("off"), F.lit(b).alias("rate")) for b in v.BITRATES))
    return F.when(F.upper(target).isin(v.LOSSLESS), F.lit(None).cast("int")).otherwise(F.array_min(steps)["rate"])


def bitrate_label(q: Column, target: Column) -> Column:
    return F.coalesce(F.concat(bitrate(q, target).cast("string"), F.lit("kbps")), F.lit("lossless"))


def rung(q: Column, what: int) -> Column:
    """Column ``what`` of the first rung whose highest quality is not below q."""
    q = clamp_quality(q)
    out = None
    for r in v.RUNGS:
        out = F.when(q <= r[0], F.lit(r[what])) if out is None else out.when(q <= r[0], F.lit(r[what]))
    return out.otherwise(F.lit(v.RUNGS[-1][what]))


def rung_size(width: Column, height: Column, cap: Column) -> tuple[Column, Column]:
    """Even width and height that keep the shape under the cap; null where there is no picture."""
    scale = F.least(F.lit(1.0), cap / height)
    even = lambda x: F.greatest(F.lit(2), F.floor(x * scale / 2 + 0.5) * 2).cast("int")
    some = (width > 0) & (height > 0)
    return F.when(some, even(width)), F.when(some, even(height))


def canvas_size(width: Column, height: Column) -> tuple[Column, Column]:
    scale = F.least(F.lit(1.0), F.lit(float(v.MAX_EDGE)) / F.greatest(width, height))
    side = lambda x: F.greatest(F.lit(1), F.floor(x * scale + 0.5)).cast("int")
    return side(width), side(height)


def frame_code(width: Column, height: Column) -> Column:
    return F.when((F.coalesce(width, F.lit(0)) == 0) | (F.coalesce(height, F.lit(0)) == 0), "decode-failed")


def _clock(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.concat(((s - F.pmod(s, F.lit(60))) / 60).cast("long").cast("string"), F.lit(":"), F.lpad(F.pmod(s, F.lit(60)).cast("string"), 2, "0"))


def fmt_duration(seconds: Column) -> Column:
    """m:ss of the rounded seconds; empty at 0."""
    s = round_half_up(seconds)
    return F.when(s > 0, _clock(s)).otherwise("")


def fmt_position(seconds: Column) -> Column:
    """m:ss of the whole seconds; 0:00 at the start."""
    return _clock(F.greatest(F.lit(0), F.floor(F.coalesce(seconds, F.lit(0.0)))))


def estimate_kb(family: Column, target: Column, size: Column, q: Column) -> Column:
    """Expected KB of the output."""
    source = F.greatest(F.lit(1.0), size / 1024.0)
    q = q.cast("double")

    def weight(f: str) -> Column:
        out = None
        for t, w in v.WEIGHTS[f].items():
            out = F.when(target == t, F.lit(w)) if out is None else out.when(target == t, F.lit(w))
        return out.otherwise(F.lit(v.MISSING_WEIGHT[f]))

    lossy = F.lit(0.4) + 0.98 * q / 100.0
    base = lambda f: source * weight(f) / v.ESTIMATE_BASE
    return (
        F.when(family == "audio", base("audio") * F.when(target.isin(v.LOSSLESS), F.lit(1.0)).otherwise(lossy) * 1.35)
        .when(family == "document", base("document") * F.when(target == "PDF", F.lit(0.6) + 0.6 * q / 100.0).otherwise(F.lit(1.0)))
        .when(family == "video", base("video") * (F.lit(0.35) + 1.85 * q / 100.0))
        .otherwise(base("image") * lossy)
    )


#: Fixed value: what the user is told is taken.
TAKEN = "images (PNG / JPG / SVG / WEBP / HEIC), audio (MP3 / WAV / OGG / AAC / M4A), video (MP4 / WEBM / MOV / MKV / AVI) or documents (TXT / MD / RTF / PDF / DOCX / EPUB) only."


def rejection(name: Column, kind: Column, size: Column, mobile: bool = False) -> Column:
    """Why a file is not taken; null if it is."""
    limit = limit_bytes(family_of(name, kind), mobile)
    seen = F.concat(F.lit(" (saw "), F.when(F.length(kind) > 0, kind).otherwise("unknown type"), F.lit(")"))
    known = is_supported(name, kind)
    return (
        F.when(size > limit, F.concat(name, F.lit(": over "), fmt_size(limit), F.lit(" — pick a smaller file.")))
        .when(~known & (stub_kind(name) == "image"), F.concat(name, F.lit(": that image type isn't supported yet — PNG / JPG / SVG / WEBP / HEIC only."), seen))
        .when(~known, F.concat(name, F.lit(f": unsupported file — {TAKEN}"), seen))
    )


def previewable(family: Column, audio: bool = False) -> Column:
    return family.isin(["image", "video", *(["audio"] if audio else [])])


def ignores_quality(family: Column, target: Column) -> Column:
    return (family == "document") & target.isin(v.IGNORES_QUALITY)


def format_time(ts: Column) -> Column:
    """Month, day and time of day."""
    return F.date_format(ts, "MMM d, HH:mm")


def active_target(target: Column, wanted: Column) -> Column:
    """A file's own target, or that of the queue."""
    return F.coalesce(target, wanted)


def tiles_family(mode: Column, queue: Column, entry: Column) -> Column:
    """The family whose targets are offered: the queue's in bulk mode, else that of the file that is open."""
    return F.when(mode == "bulk", queue).otherwise(F.coalesce(entry, queue))


def recorder_for(target: Column, offered: Column) -> Column:
    """The first container type of a target, in order of preference, that is among those offered; null if none is."""
    table = F.create_map(*(x for t, kinds in v.RECORDER_TYPES.items() for x in (F.lit(t), F.array(*map(F.lit, kinds)))))
    return F.get(F.filter(F.try_element_at(table, target), lambda kind: F.array_contains(offered, kind)), F.lit(0))


def is_family(family: Column, which: str) -> Column:
    return F.coalesce(family == which, F.lit(False))


def tile_status(family: Column, target: Column, supported: Column) -> Column:
    """What a target's tile says: nothing if it can be made; input only for formats that are read alone; else no support."""
    read_alone = ((family == "image") & (target == "HEIC")) | ((family == "video") & target.isin("MOV", "MKV", "AVI") & ~supported)
    checked = ((family != "image") | (target == "WEBP")) & ~supported
    return F.when(read_alone, "INPUT ONLY").when(checked, "NO SUPPORT").otherwise("")
