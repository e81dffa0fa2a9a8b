"""What a file is: format, encoding, separator, preamble, header. Looks at a bounded head of the file."""

from __future__ import annotations

import csv
import io
import statistics
from dataclasses import dataclass
from pathlib import Path

#: (offset, bytes, format): these beat the suffix.
MAGIC = [(0, b"PAR1", "parquet"), (0, b"SIMPLE  =", "fits"), (0, b"CDF", "netcdf"), (0, b"\x89HDF", "netcdf"), (8, b"DUCK", "duckdb"), (0, b"PK\x03\x04", "excel"), (0, b"\xd0\xcf\x11\xe0", "excel")]
SUFFIXES = {".csv": "csv", ".tsv": "csv", ".txt": "csv", ".parquet": "parquet", ".pq": "parquet", ".json": "json", ".ndjson": "ndjson", ".jsonl": "ndjson", ".xlsx": "excel", ".xls": "excel", ".fits": "fits", ".fit": "fits", ".nc": "netcdf", ".cdf": "netcdf", ".duckdb": "duckdb", ".db": "duckdb", ".sqlite": "duckdb", ".orc": "orc", ".avro": "avro"}
BOMS = [(b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")]
DELIMITERS = ",;\t|:"
HEAD_BYTES, HEAD_LINES = 1 << 16, 200


@dataclass
class FileProfile:
    path: Path
    fmt: str
    encoding: str = "utf-8"
    separator: str | None = None
    has_header: bool = True
    skip_rows: int = 0


def detect_format(path: str | Path) -> str:
    path = Path(path)
    with path.open("rb") as f:
        head = f.read(64)
    for at, magic, fmt in MAGIC:
        if head[at : at + len(magic)] == magic:
            return fmt
    fmt = SUFFIXES.get(path.suffix.lower(), "csv")
    if fmt == "json":
        return "json" if head.lstrip()[:1] == b"[" or _one_document(path) else "ndjson"
    return fmt


def _one_document(path: Path) -> bool:
    """Whether a .json file that opens with a brace is a single document: its first line isn't one by itself."""
    import json

    with path.open("rb") as f:
        line = f.readline(1 << 20)
        more = f.readline(1 << 20).strip()
    try:
        json.loads(line)
    except ValueError:
        return True
    return not more


def wide_encoding(chunk: bytes) -> str | None:
    """UTF-16 or UTF-32 without a mark, told by how many bytes are NUL and where."""
    if len(chunk) < 16:
        return None
    share = chunk.count(0) / len(chunk)
    if share < 0.25:
        return None
    width = 4 if share > 0.6 else 2
    little = chunk[width - 1 :: width].count(0) >= chunk[0::width].count(0)
    return f"utf-{8 * width}-{'le' if little else 'be'}"


def detect_encoding(path: str | Path) -> str:
    with Path(path).open("rb") as f:
        chunk = f.read(HEAD_BYTES)
    for mark, name in BOMS:
        if chunk.startswith(mark):
            return name
    if wide := wide_encoding(chunk):
        return wide
    try:
        chunk.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError as e:
        return "utf-8" if e.start >= len(chunk) - 3 and len(chunk) == HEAD_BYTES else "latin-1"


def head_lines(path: str | Path, encoding: str) -> list[str]:
    with Path(path).open(encoding=encoding, errors="replace", newline=None) as f:
        return [line.rstrip("\n") for _, line in zip(range(HEAD_LINES), f) if line.strip()]


def field_count(line: str, separator: str) -> int:
    quoted, n = False, 1
    for c in line:
        if c == '"':
            quoted = not quoted
        elif c == separator and not quoted:
            n += 1
    return n


def delimiter_score(lines: list[str], separator: str) -> float:
    counts = [field_count(line, separator) for line in lines]
    if not counts or max(counts) < 2:
        return -1.0
    return statistics.median(counts) - statistics.pstdev(counts)


def detect_delimiter(lines: list[str]) -> str:
    lines = lines[:50]
    scores = {d: delimiter_score(lines, d) for d in DELIMITERS}
    best = max(DELIMITERS, key=lambda d: scores[d])
    return best if scores[best] > 0 else ","


def numeric_share(row: list[str]) -> float:
    def number(v: str) -> bool:
        try:
            float(v.replace(",", "").strip())
            return True
        except ValueError:
            return False

    return sum(map(number, row)) / len(row) if row else 0.0


def detect_preamble(lines: list[str], separator: str) -> int:
    """Lines before the first one that is as wide as most; within the first eleven."""
    counts = [field_count(line, separator) for line in lines]
    if len(counts) < 3:
        return 0
    modal = max(sorted(set(counts), reverse=True), key=counts.count)
    if modal < 2:
        return 0
    return next((i for i, n in enumerate(counts[:11]) if n == modal), 0)


def detect_header(lines: list[str], separator: str) -> bool:
    rows = list(csv.reader(io.StringIO("\n".join(lines)), delimiter=separator))
    rows = [r for r in rows if r]
    if len(rows) < 2:
        return True
    first, body = rows[0], rows[1:]
    if numeric_share(first) == 0 and numeric_share(body[0]) > 0:
        return True
    if numeric_share(first) > 0:
        return False
    names = [v.strip() for v in first]
    if any(not v for v in names) or len(set(names)) < len(names):
        return False
    return all(all(len(r) <= i or r[i].strip() != v for r in body) for i, v in enumerate(names))


def profile_source(path: str | Path) -> FileProfile:
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(path)
    fmt = detect_format(path)
    if fmt != "csv":
        return FileProfile(path, fmt)
    encoding = detect_encoding(path)
    lines = head_lines(path, encoding)
    separator = "\t" if path.suffix.lower() == ".tsv" else detect_delimiter(lines)
    skip = detect_preamble(lines, separator)
    return FileProfile(path, fmt, encoding, separator, detect_header(lines[skip:], separator), skip)
