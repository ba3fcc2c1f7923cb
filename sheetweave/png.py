"""A PNG writer for rectangles, lines and small capitals, standard library only."""

from __future__ import annotations

import struct
import zlib


#: Letters of three by five points; a digit for each row, its bits from the left.
GLYPHS = {
    "A": "25755", "B": "65656", "C": "34443", "D": "65556", "E": "74647", "F": "74644", "G": "34553", "H": "55755", "I": "72227", "J": "11152", "K": "55655", "L": "44447", "M": "57755",
    "N": "57775", "O": "25552", "P": "65644", "Q": "25563", "R": "65655", "S": "34216", "T": "72222", "U": "55557", "V": "55552", "W": "55775", "X": "55255", "Y": "55222", "Z": "71247",
    "0": "75557", "1": "26227", "2": "61247", "3": "61216", "4": "55711", "5": "74616", "6": "34757", "7": "71222", "8": "75757", "9": "75716",
    " ": "00000", ".": "00002", ",": "00024", ":": "02020", "-": "00700", "_": "00007", "%": "51245", "/": "11244", "+": "02720", "=": "07070", "(": "12221", ")": "42224", "!": "22202",
    "?": "61202", "#": "57575", "'": "22000", '"': "55000", "*": "52500", "<": "12421", ">": "42124", "$": "36763",
}
#: What any other character is drawn as.
OTHER = "75557"
THREE, FIVE = 3, 5

#: Fixed value: what a theme's colour is shown as.
THEME = (248, 248, 238)


def rgb(color: str | None) -> tuple[int, int, int] | None:
    """Red, green and blue of RGB or ARGB hex digits; none of a clear or unreadable one."""
    if color == "theme":
        return THEME
    six = (color or "")[-6:]
    if len(color or "") not in (6, 8) or not all(ch in "0123456789abcdefABCDEF" for ch in color) or color == "00000000":
        return None
    return int(six[:2], 16), int(six[2:4], 16), int(six[4:], 16)


class Canvas:
    def __init__(self, width: int, height: int, fill: tuple[int, int, int] = (255, 255, 255)):
        self.width, self.height = width, height
        self.rows = [bytearray(bytes(fill) * width) for _ in range(height)]

    def rectangle(self, x0: int, y0: int, x1: int, y1: int, fill: tuple[int, int, int]) -> None:
        x0, x1 = max(0, x0), min(self.width - 1, x1)
        if x0 <= x1:
            run = bytes(fill) * (x1 - x0 + 1)
            for y in range(max(0, y0), min(self.height - 1, y1) + 1):
                self.rows[y][3 * x0 : 3 * (x1 + 1)] = run

    def outline(self, x0: int, y0: int, x1: int, y1: int, color: tuple[int, int, int], width: int = 1) -> None:
        for a in ((x0, y0, x1, y0 + width - 1), (x0, y1 - width + 1, x1, y1), (x0, y0, x0 + width - 1, y1), (x1 - width + 1, y0, x1, y1)):
            self.rectangle(*a, color)

    def text(self, x: int, y: int, text: str, color: tuple[int, int, int], size: int = 2, room: int | None = None) -> None:
        """One line of text from its upper left corner on, as much of it as the room in pixels holds."""
        wide = (THREE + 1) * size
        fits = len(text) if room is None else max(0, room // wide)
        for k, ch in enumerate(text.upper()[:fits]):
            for row, bits in enumerate(map(int, GLYPHS.get(ch, OTHER))):
                for col in range(THREE):
                    if bits >> (THREE - 1 - col) & 1:
                        at = x + k * wide + col * size, y + row * size
                        self.rectangle(*at, at[0] + size - 1, at[1] + size - 1, color)

    def paste(self, other: Canvas, x0: int, y0: int, x1: int, y1: int) -> None:
        """Another picture drawn into the rectangle, points repeated or left out."""
        wide, high = x1 - x0 + 1, y1 - y0 + 1
        left, right = max(0, x0), min(self.width - 1, x1)
        if wide < 1 or high < 1 or left > right:
            return
        at = [(x - x0) * other.width // wide * 3 for x in range(left, right + 1)]
        for y in range(max(0, y0), min(self.height - 1, y1) + 1):
            row = other.rows[(y - y0) * other.height // high]
            self.rows[y][3 * left : 3 * (right + 1)] = b"".join(row[k : k + 3] for k in at)

    def png(self) -> bytes:
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        raw = b"".join(b"\0" + bytes(r) for r in self.rows)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", self.width, self.height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _unfiltered(raw: bytes, stride: int, step: int, height: int) -> list[bytearray]:
    """Rows of a PNG's data after its filters are taken back."""
    rows, before = [], bytearray(stride)
    for y in range(height):
        kind, row = raw[y * (stride + 1)], bytearray(raw[y * (stride + 1) + 1 : (y + 1) * (stride + 1)])
        for k in range(stride) if kind else ():
            a, b, c = (row[k - step] if k >= step else 0), before[k], (before[k - step] if k >= step else 0)
            nearest = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            row[k] = (row[k] + (a, b, (a + b) // 2, nearest)[kind - 1]) & 255
        rows.append(row)
        before = row
    return rows


def decode(data: bytes) -> Canvas | None:
    """A PNG of eight bits a channel that isn't interlaced, over white; none for anything else."""
    try:
        if data[:8] != b"\x89PNG\r\n\x1a\n":
            return None
        width, height, depth, kind, _, _, laced = struct.unpack(">IIBBBBB", data[16:29])
        step = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
        if depth != 8 or laced or width * height > 1 << 22:
            return None
        at, body, palette = 8, b"", b""
        while at < len(data):
            size, name = struct.unpack(">I4s", data[at : at + 8])
            body += data[at + 8 : at + 8 + size] if name == b"IDAT" else b""
            palette = data[at + 8 : at + 8 + size] if name == b"PLTE" else palette
            at += 12 + size
        rows, out = _unfiltered(zlib.decompress(body), width * step, step, height), Canvas(width, height)
    except (KeyError, IndexError, struct.error, zlib.error):
        return None
    over = lambda v, alpha: (v * alpha + 255 * (255 - alpha)) // 255
    for y, row in enumerate(rows):
        if kind == 2:
            out.rows[y][:] = row
            continue
        for x in range(width):
            p = row[x * step : (x + 1) * step]
            color = palette[3 * p[0] : 3 * p[0] + 3] if kind == 3 else bytes(p[:1]) * 3 if kind in (0, 4) else bytes(p[:3])
            out.rows[y][3 * x : 3 * x + 3] = bytes(over(v, p[-1]) for v in color) if kind in (4, 6) else color
    return out
