"""Default limits and lists; every operator takes them as keyword arguments."""

from __future__ import annotations

# Names a scan leaves out.
EXCLUDED_DIRS = ("target", "node_modules", ".svn", "eclipse", ".metadata", ".settings", ".idea", ".gradle", ".git")
EXCLUDED_FILES = ("Thumbs.db", "desktop.ini", "Desktop.ini")

# Limits of jobs and reports.  Byte sizes are decimal.
MAX_HASH_FILES = 1000
MAX_HASH_SIZE = 700_000_000
MAX_HASH_DEVICES = 2
BACKUP_ROWS = 200
MIN_COPIES = 2
DUPLICATE_SIZE = 20_000_000
CATEGORY_ROWS = 500
CATEGORY_DIR_FILES = 100
MOVE_JOBS = 2
MOVE_FILES = 200
IMAGE_ROWS = 350
DEVICE_ROWS = 200
PATH_ROWS = 100
SEARCH_ROWS = 100
IMAGE_CACHE = "images-cache"
COPY_FROM = "/sdcard/DCIM/Camera/"
COPY_TO = "/tmp/cp_back/"

# Media type by lower-case extension.
MIME_TYPES = {
    "avi": "video/x-msvideo", "bmp": "image/bmp", "css": "text/css", "csv": "text/csv", "doc": "application/msword",
    "flac": "audio/flac", "gif": "image/gif", "gz": "application/gzip", "htm": "text/html", "html": "text/html",
    "jpeg": "image/jpeg", "jpg": "image/jpeg", "js": "text/javascript", "json": "application/json",
    "mkv": "video/x-matroska", "mov": "video/quicktime", "mp3": "audio/mpeg", "mp4": "video/mp4",
    "odt": "application/vnd.oasis.opendocument.text", "pdf": "application/pdf", "png": "image/png",
    "svg": "image/svg+xml", "tar": "application/x-tar", "tif": "image/tiff", "tiff": "image/tiff",
    "txt": "text/plain", "wav": "audio/x-wav", "webp": "image/webp", "xls": "application/vnd.ms-excel",
    "xml": "application/xml", "zip": "application/zip",
}
