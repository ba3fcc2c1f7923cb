"""Column expressions over inclusive, 1-based rectangles with the columns r0, c0, r1, c1 (under a prefix, if given)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ROW, MAX_COL = 1_048_576, 16_384
SIDES = ("r0", "c0", "r1", "c1")
KEY = ("workbook", "sheet")
#: Border styles that count as strong.
STRONG = ("medium", "thick", "double", "mediumDashed", "mediumDashDot", "mediumDashDotDot", "slantDashDot")


class Box:
    """The four sides of a rectangle as columns."""

    def __init__(self, source: str | Column = "", sides: tuple[Column, Column, Column, Column] | None = None):
        if sides is None:
            sides = tuple(source.getField(s) for s in SIDES) if isinstance(source, Column) else tuple(F.col(source + s) for s in SIDES)
        self.r0, self.c0, self.r1, self.c1 = sides

    @property
    def height(self) -> Column:
        return self.r1 - self.r0 + 1

    @property
    def width(self) -> Column:
        return self.c1 - self.c0 + 1

    @property
    def area(self) -> Column:
        return self.height.cast("long") * self.width

    @property
    def range_ref(self) -> Column:
        return F.concat(col_letter(self.c0), self.r0.cast("string"), F.lit(":"), col_letter(self.c1), self.r1.cast("string"))

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.cast("int").alias(prefix + s) for s, c in zip(SIDES, (self.r0, self.c0, self.r1, self.c1), strict=True)]

    def struct(self) -> Column:
        return F.struct(*self.columns())

    def union(self, o: Box) -> Box:
        return Box(sides=(F.least(self.r0, o.r0), F.least(self.c0, o.c0), F.greatest(self.r1, o.r1), F.greatest(self.c1, o.c1)))

    def clip(self, o: Box) -> Box:
        """What both share; inverted (see valid) where they don't touch."""
        return Box(sides=(F.greatest(self.r0, o.r0), F.greatest(self.c0, o.c0), F.least(self.r1, o.r1), F.least(self.c1, o.c1)))

    @property
    def valid(self) -> Column:
        return (self.r0 <= self.r1) & (self.c0 <= self.c1)

    def contains_cell(self, row: Column, col: Column) -> Column:
        return row.between(self.r0, self.r1) & col.between(self.c0, self.c1)

    def contains(self, o: Box) -> Column:
        return (self.r0 <= o.r0) & (self.c0 <= o.c0) & (self.r1 >= o.r1) & (self.c1 >= o.c1)

    def intersects(self, o: Box) -> Column:
        return (self.r0 <= o.r1) & (o.r0 <= self.r1) & (self.c0 <= o.c1) & (o.c0 <= self.c1)

    def same(self, o: Box) -> Column:
        return (self.r0 == o.r0) & (self.c0 == o.c0) & (self.r1 == o.r1) & (self.c1 == o.c1)

    def intersection_area(self, o: Box) -> Column:
        shared = self.clip(o)
        return F.greatest(F.lit(0), shared.height).cast("long") * F.greatest(F.lit(0), shared.width)

    def axis_overlap(self, o: Box, rows: bool) -> Column:
        """Shared length on an axis over the shorter of the two extents."""
        a, b = ((self.r0, self.r1), (o.r0, o.r1)) if rows else ((self.c0, self.c1), (o.c0, o.c1))
        shared = F.greatest(F.lit(0), F.least(a[1], b[1]) - F.greatest(a[0], b[0]) + 1)
        return shared / F.greatest(F.lit(1), F.least(a[1] - a[0] + 1, b[1] - b[0] + 1))

    def takes_shell(self, border: Box, cfg) -> Column:
        """Whether a value box grows to this border box."""
        shared = self.intersection_area(border)
        tops = F.greatest(self.r0 - border.r0, border.r1 - self.r1)
        lefts = F.greatest(self.c0 - border.c0, border.c1 - self.c1)
        return (
            (shared > 0) & (shared / self.area >= cfg.border_expand_min_value_overlap) & (border.area <= self.area * cfg.border_expand_max_area_ratio)
            & (tops <= cfg.border_expand_max_extra_rows) & (lefts <= cfg.border_expand_max_extra_cols) & (shared / border.area >= cfg.border_expand_min_border_overlap)
        )

    def contact_neighbour(self, o: Box, max_gap: int, min_overlap: float) -> Column:
        """Neighbours across a gap; rows are looked at before columns, so boxes set off on both axes aren't."""
        row_gap = F.when(self.r1 < o.r0, o.r0 - self.r1 - 1).when(o.r1 < self.r0, self.r0 - o.r1 - 1)
        col_gap = F.when(self.c1 < o.c0, o.c0 - self.c1 - 1).when(o.c1 < self.c0, self.c0 - o.c1 - 1)
        return (
            F.when(self.contains(o) | o.contains(self), False)
            .when(row_gap.isNotNull(), (row_gap <= max_gap) & (self.axis_overlap(o, rows=False) >= min_overlap))
            .when(col_gap.isNotNull(), (col_gap <= max_gap) & (self.axis_overlap(o, rows=True) >= min_overlap))
            .otherwise(True)
        )


def col_letter(n: Column) -> Column:
    """Column letters of 1 to 18278."""
    letter = lambda k: F.char(F.lit(65) + (k % 26).cast("int"))
    two, three = n - 27, n - 703
    return (
        F.when(n <= 26, letter(n - 1)).when(n <= 702, F.concat(letter(F.floor(two / 26)), letter(two)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26)), letter(three)))
    )


def col_number(letters: Column) -> Column:
    up, n = F.upper(letters), F.length(letters)
    at = lambda k: F.ascii(F.substring(up, k, 1)) - 64
    return F.when(n == 1, at(1)).when(n == 2, at(1) * 26 + at(2)).when(n == 3, at(1) * 676 + at(2) * 26 + at(3))


_REF = r"^\$?([A-Za-z]{1,3})\$?(\d+)(?::\$?([A-Za-z]{1,3})\$?(\d+))?$"


def parse_range(ref: Column) -> Column:
    """A struct of sides, null for what isn't a range; one cell is a range of itself."""
    part = lambda k: F.regexp_extract(ref, _REF, k)
    c0, r0 = col_number(part(1)), part(2).try_cast("int")
    c1, r1 = F.coalesce(col_number(F.nullif(part(3), F.lit(""))), c0), F.coalesce(part(4).try_cast("int"), r0)
    return F.when(ref.rlike(_REF), F.struct(r0.alias("r0"), c0.cast("int").alias("c0"), r1.alias("r1"), c1.cast("int").alias("c1")))


def local_range_ref(formula: Column) -> Column:
    """A chart formula's range without sheet and dollar signs; null if it isn't one."""
    ref = F.trim(F.replace(F.regexp_replace(formula, r"^[^!]*!", ""), F.lit("$"), F.lit("")))
    ref = F.regexp_replace(ref, r"^'+|'+$", "")
    return F.when(ref.rlike(_REF) | ref.rlike(r"^[A-Za-z]{1,3}:[A-Za-z]{1,3}$") | ref.rlike(r"^\d+:\d+$"), ref)


def column_pixels(width: Column) -> Column:
    return F.greatest(F.lit(4), (F.coalesce(width, F.lit(8.43)) * 7 + 5).cast("int"))


def row_pixels(points: Column) -> Column:
    return F.greatest(F.lit(4), (F.coalesce(points, F.lit(15.0)) * 96 / 72).cast("int"))


def is_non_empty(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def has_style(style: Column, strong: bool) -> Column:
    return F.coalesce(style.isin(*STRONG) if strong else style.isNotNull() & (style != ""), F.lit(False))


def safe_name(name: Column) -> Column:
    return F.translate(name, '\\/:*?"<>|', "_________")


def safe_filename_part(text: Column, fallback: str = "image") -> Column:
    """An image's name for a file: colons and slashes one by one, runs of other characters as one underscore."""
    out = F.regexp_replace(F.translate(text, ":/\\", "___"), r"[^0-9A-Za-z가-힣_.()\-]+", "_")
    out = F.trim(out, F.lit("_"))
    return F.when(out == "", fallback).otherwise(out)


#: Suffixes that an image keeps.
SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".tif", ".tiff")


def image_extension(media: Column, data: Column) -> Column:
    suffix, magic = F.lower(F.regexp_extract(media, r"(\.[^./\\]+)$", 1)), F.hex(F.substring(data, 1, 16))
    return (
        F.when(suffix.isin(*SUFFIXES), suffix).when(magic.startswith("89504E47"), ".png").when(magic.startswith("FFD8"), ".jpg").when(magic.startswith("474946"), ".gif")
        .when(magic.startswith("52494646") & (F.instr(magic, "57454250") > 0), ".webp").otherwise(".bin")
    )
