"""A small PDF writer for text and tables: standard fonts, nothing embedded, nothing fetched."""

from __future__ import annotations

WIDTH, HEIGHT, MARGIN = 595, 842, 42
#: (font, size, height of a line) by style.
STYLES = {"title": ("F2", 16, 24), "heading": ("F2", 12, 20), "text": ("F1", 9, 13), "table": ("F3", 7, 9)}
#: Characters of a table's line.
LINE = 120


def _escaped(text: str) -> bytes:
    """Text of the standard encoding; what it doesn't hold becomes a question mark."""
    return text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")


def wrapped(text: str, width: int) -> list[str]:
    out, line = [], ""
    for word in text.split():
        while len(word) > width:
            word, rest = word[:width], word[width:]
            out += [line] if line else []
            out, line, word = [*out, word], "", rest
        if line and len(line) + 1 + len(word) > width:
            out.append(line)
            line = word
        else:
            line = f"{line} {word}".strip()
    return [*out, line] if line or not out else out


def table_lines(header: list[str], rows: list[list[str]]) -> list[str]:
    """Columns as wide as their longest cell, cut so that all fit into a line."""
    n = max(1, len(header))
    most = max(4, LINE // n - 1)
    widths = [min(most, max(len(str(r[i])) for r in [header, *rows])) for i in range(len(header))]
    return [" ".join(str(v)[:w].ljust(w) for v, w in zip(r, widths)) for r in [header, ["-" * w for w in widths], *rows]]


def pdf(blocks: list[tuple[str, list[str]]]) -> bytes:
    """blocks: (style, lines), laid out from top to bottom over as many pages as they need."""
    pages: list[list[bytes]] = [[]]
    y = HEIGHT - MARGIN
    for style, lines in blocks:
        font, size, step = STYLES[style]
        for line in lines:
            for part in wrapped(line, 100) if style == "text" else [line]:
                if y - step < MARGIN:
                    pages.append([])
                    y = HEIGHT - MARGIN
                y -= step
                pages[-1].append(b"BT /%s %d Tf %d %d Td (%s) Tj ET" % (font.encode(), size, MARGIN, y, _escaped(part)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
    objects += [b"<< /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding >>" % f for f in (b"Helvetica", b"Helvetica-Bold", b"Courier")]
    kids = []
    for page in pages:
        stream = b"\n".join(page)
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R /F2 4 0 R /F3 5 0 R >> >> /Contents %d 0 R >>" % (WIDTH, HEIGHT, len(objects)))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(kids), len(kids))
    out, places = b"%PDF-1.4\n", []
    for i, x in enumerate(objects):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i + 1, x)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))
