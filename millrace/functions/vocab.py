"""The vocabulary of formats: lists, limits, weights and rungs, and tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Media types, extensions and targets by family.
IMAGE_TYPES = ["image/png", "image/jpeg", "image/svg+xml", "image/webp", "image/heic", "image/heif"]
IMAGE_EXTS = [".png", ".jpg", ".jpeg", ".svg", ".webp", ".heic", ".heif"]
AUDIO_TYPES = [
    "audio/mpeg", "audio/mp3", "audio/x-mp3", "audio/x-mpeg", "audio/mpeg3", "audio/wav", "audio/x-wav", "audio/wave", "audio/aac",
    "audio/aacp", "audio/ogg", "audio/opus", "audio/x-opus", "audio/mp4", "audio/x-m4a", "audio/webm", "audio/3gpp", "audio/3gpp2",
]
AUDIO_EXTS = [".mp3", ".wav", ".aac", ".ogg", ".oga", ".opus", ".m4a", ".weba", ".3gp"]
DOCUMENT_TYPES = [
    "text/plain", "text/markdown", "text/x-markdown", "application/rtf", "text/rtf", "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/epub+zip",
]
DOCUMENT_EXTS = [".txt", ".md", ".markdown", ".rtf", ".pdf", ".docx", ".epub"]
VIDEO_TYPES = ["video/mp4", "video/quicktime", "video/webm", "video/x-matroska", "video/x-msvideo", "video/avi", "video/mpeg"]
VIDEO_EXTS = [".mp4", ".mov", ".webm", ".mkv", ".avi"]
STUB_EXTS = [".bmp", ".tiff", ".tif"]
TYPES = {"image": IMAGE_TYPES, "audio": AUDIO_TYPES, "document": DOCUMENT_TYPES, "video": VIDEO_TYPES}
EXTS = {"image": IMAGE_EXTS, "audio": AUDIO_EXTS, "document": DOCUMENT_EXTS, "video": VIDEO_EXTS}
TARGETS = {
    "image": ["PNG", "JPG", "SVG", "WEBP"],
    "audio": ["MP3", "WAV", "OGG", "AAC", "M4A"],
    "document": ["TXT", "MD", "RTF", "PDF", "DOCX", "EPUB"],
    "video": ["MP4", "WEBM", "MOV", "MKV", "AVI"],
}
INPUT_ONLY = {"HEIC": "input only"}
PICKER = {"image": ["png", "jpg", "svg", "webp"], "audio": ["mp3", "wav", "ogg", "aac", "m4a"], "document": ["txt", "md", "rtf", "pdf", "docx", "epub"], "video": ["mp4", "mov", "webm", "mkv", "avi"]}
DEFAULT_TARGET = {"image": "WEBP", "audio": "MP3", "video": "MP4", "document": "PDF"}
FALLBACK = {"WEBP": "JPG", "MP3": "WAV", "PDF": "TXT", "MP4": "WEBM"}
LOSSLESS = ["WAV"]
IGNORES_QUALITY = ["TXT", "MD", "RTF", "DOCX", "EPUB"]
MEDIA_TYPE = {
    "PNG": "image/png", "JPG": "image/jpeg", "SVG": "image/svg+xml", "WEBP": "image/webp",
    "MP3": "audio/mpeg", "WAV": "audio/wav", "OGG": "audio/ogg", "AAC": "audio/aac", "M4A": "audio/mp4",
    "TXT": "text/plain", "MD": "text/markdown", "RTF": "application/rtf", "PDF": "application/pdf",
    "DOCX": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "EPUB": "application/epub+zip",
    "MP4": "video/mp4", "WEBM": "video/webm", "MOV": "video/quicktime", "MKV": "video/x-matroska", "AVI": "video/x-msvideo",
}

# Limits of a batch and of a file.
MAX_FILES = 20
MAX_BYTES = 50 * 1024 * 1024
MAX_BYTES_VIDEO = 1024 * 1024 * 1024
MAX_BYTES_VIDEO_MOBILE = 200 * 1024 * 1024

# Weights of the size estimate, and what stands in for a missing one.
ESTIMATE_BASE = 1.2
WEIGHTS = {
    "image": {"PNG": 1.0, "JPG": 0.45, "SVG": 1.35, "WEBP": 0.35},
    "audio": {"MP3": 0.32, "AAC": 0.3, "OGG": 0.27, "M4A": 0.3, "WAV": 1.4},
    "document": {"TXT": 0.9, "MD": 1.0, "RTF": 1.25, "PDF": 1.1, "DOCX": 1.15, "EPUB": 1.2},
    "video": {"MP4": 0.9, "WEBM": 0.7, "MOV": 1.0, "MKV": 0.95, "AVI": 1.25},
}
MISSING_WEIGHT = {"image": 0.4, "audio": 0.32, "document": 1.0, "video": 0.9}

# Quality scales.
DEFAULT_QUALITY = 82
BITRATES = [64, 96, 128, 160, 192, 256, 320]
MP3_RATES = [8000, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000]
#: (highest quality, cap of the height, label, bits a second)
RUNGS = [(20, 480, "480p", 1_000_000), (40, 720, "720p", 2_500_000), (60, 1080, "1080p", 5_000_000), (80, 1440, "2K", 10_000_000), (100, 2160, "4K", 16_000_000)]
MAX_EDGE = 4096
MP3_BLOCK = 1152

# Container types that a recorder may offer for a target, in order of preference.
RECORDER_TYPES = {
    "MP3": ["audio/mpeg", "audio/mp3"],
    "OGG": ["audio/ogg;codecs=opus", "audio/ogg;codecs=vorbis", "audio/ogg", "audio/webm;codecs=opus"],
    "AAC": ["audio/aac", "audio/mp4;codecs=mp4a.40.2", "audio/mp4"],
    "M4A": ["audio/mp4;codecs=mp4a.40.2", "audio/mp4", "audio/aac"],
    "WAV": ["audio/wav"],
    "MP4": ["video/mp4;codecs=avc1.42E01E,mp4a.40.2", "video/mp4"],
    "WEBM": ["video/webm;codecs=vp9,opus", "video/webm;codecs=vp8,opus", "video/webm"],
}

# What a user reads for an error code. {target} is the wanted format.
REASONS = {
    "unsupported-target": "{target} isn't a supported output here — pick another format",
    "no-toblob": "canvas export isn't available in this browser — try another browser",
    "no-2d-context": "canvas 2D isn't available in this browser — try another browser",
    "encode-failed": "{target} encoding failed — try again or pick another format",
    "ffmpeg-api-unknown": "optional video encoder has an unknown API — try MP4 or WEBM",
    "xml-corrupt": "couldn't be read — the file's XML looks damaged",
    "zip-unsupported-method": "{target} uses a ZIP method this browser can't write — try TXT or PDF",
    "heic-unsupported": "HEIC isn't decodable in this browser — try Safari or export to JPG first",
    "webp-unsupported": "WebP encoding isn't supported in this browser — try JPG",
    "heic-output-unsupported": "HEIC output isn't supported — pick another format",
    "mp3-unsupported": "MP3 encoding isn't supported in this browser — try WAV",
    "video-unsupported": "couldn't be read as video in this browser — the file may use an unsupported codec",
    "mp4-unsupported": "MP4 encoding isn't supported in this browser — try WEBM",
    "webm-unsupported": "WEBM encoding isn't supported in this browser — try MP4",
    "mov-unsupported": "MOV needs the optional local encoder, which isn't loaded — try MP4 or WEBM",
    "mkv-unsupported": "MKV needs the optional local encoder, which isn't loaded — try MP4 or WEBM",
    "avi-unsupported": "AVI needs the optional local encoder, which isn't loaded — try MP4 or WEBM",
    "ogg-unsupported": "OGG encoding isn't supported in this browser — try WAV or MP3",
    "aac-unsupported": "AAC encoding isn't supported in this browser — try WAV or MP3",
    "m4a-unsupported": "M4A encoding isn't supported in this browser — try WAV or MP3",
    "pdf-unsupported": "PDF reading isn't available — the reader failed to load, try again",
    "pdf-no-text": "no extractable text — scanned PDF with nothing recognized",
    "ocr-unsupported": "scanned PDF needs the OCR engine, which couldn't load — try a text PDF",
    "ocr-failed": "couldn't read the scanned pages — try a text-based PDF",
    "zip-unsupported": "{target} needs ZIP support this browser lacks — try TXT or PDF",
    "zip-encrypted": "couldn't be read — encrypted container, remove the password first",
    "zip-corrupt": "couldn't be read — the container looks damaged",
    "docx-corrupt": "couldn't be read — the file may be damaged",
    "epub-corrupt": "couldn't be read — the file may be damaged",
    "rtf-corrupt": "couldn't be read — the file may be damaged",
    "docx-no-text": "no convertible text found in the file",
    "epub-no-text": "no convertible text found in the file",
    "encode-unsupported": "{target} encoding isn't supported in this browser — try WAV",
    "encode-timeout": "{target} encoding isn't supported in this browser — try WAV",
    "webaudio-unsupported": "audio decoding isn't supported in this browser",
}
VIDEO_REASONS = {
    "encode-unsupported": "{target} encoding isn't supported in this browser — try MP4",
    "encode-timeout": "timed out while recording — try a shorter clip or a lower quality rung",
}
DEFAULT_REASON = "couldn't be read in this browser"


def targets_table(spark: SparkSession) -> DataFrame:
    """family, position, target, available, label of what the pickers offer."""
    rows = [(f, i, t, True, None) for f, ts in TARGETS.items() for i, t in enumerate(ts)]
    rows += [("image", len(TARGETS["image"]), t, False, label) for t, label in INPUT_ONLY.items()]
    return spark.createDataFrame(rows, "family string, position int, target string, available boolean, label string")


def rungs_table(spark: SparkSession) -> DataFrame:
    low = [0, *(r[0] for r in RUNGS[:-1])]
    return spark.createDataFrame([(a, *r) for a, r in zip(low, RUNGS, strict=True)], "low int, high int, cap_height int, label string, bps int")


def reasons_table(spark: SparkSession) -> DataFrame:
    """code, family (null: any), reason with {target} open."""
    rows = [(c, None, r) for c, r in REASONS.items()] + [(c, "video", r) for c, r in VIDEO_REASONS.items()]
    return spark.createDataFrame(rows, "code string, family string, reason string")
