"""Closed vocabularies and limits as plain values, and as small DataFrames to join with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# What a page, a brief and a direction may say.
STRUCTURES = ("claim", "kpi", "compare", "flow", "loop", "funnel", "timeline", "hierarchy", "composition", "matrix", "layers", "roles", "checklist", "list")
SKELETONS = ("hero", "split", "diagram", "cards", "bignum", "table", "bands", "radial", "asym", "quadrant")
KINDS = ("cover", "agenda", "summary", "section", "content", "closing", "appendix")
CONTENT_KINDS = ("content", "summary", "agenda", "appendix")
IMAGERY_MODES = ("photo", "still_life", "illustration", "graphic", "material", "3d", "typographic")
DIMENSIONS = ("typeface", "palette", "layout", "imagery", "texture", "diagram")
AXES = {
    "typeface": ("serif_title", "sans_bold", "serif_book", "contrast", "rounded"),
    "layout": ("swiss_grid", "magazine_asym", "centered", "modular", "fullbleed"),
    "texture": ("flat_print", "paper", "cinematic", "grain", "gloss"),
    "diagram": ("hairline", "solid", "hand_drawn", "isometric", "print_block"),
    "color_strategy": ("restrained", "dominant", "multi", "drenched"),
}
DISTINCT_AXES = ("typeface", "layout", "texture", "diagram")
ICON_POLICIES = ("none", "planned", "illustrative")
TEMPERATURES = ("safe", "distinct")
TYPE_CLASSES, BODY_CLASSES = ("hei", "song", "kai", "yuan", "xingkai"), ("hei", "song")
PROBLEM_TYPES = ("skeleton", "focal", "relations", "extra_labels", "icons", "style", "text", "corner", "other")
VERDICTS = ("pass", "regen", "fix")
BRIEF_FIELDS = ("message", "structure", "form", "focal", "skeleton")
AVOIDED = ("3d", "glass", "glow", "gradient", "float", "underline", "badges", "robot")
# By skeleton, body characters and strings that a page holds when shown and when read.
CAPACITY = {
    "hero": ((40, 5), (80, 12)), "bignum": ((60, 8), (120, 12)), "split": ((100, 10), (190, 25)), "asym": ((100, 10), (190, 25)),
    "cards": ((100, 10), (190, 16)), "diagram": ((120, 14), (250, 28)), "bands": ((120, 14), (250, 28)), "radial": ((120, 14), (250, 28)),
    "quadrant": ((120, 14), (250, 28)), "table": ((120, 99), (250, 99)),
}
# Words that speak for a reference file, and the sections of a brand study.
KEYWORDS_CJK = ("参考", "风格", "视觉", "设计", "灵感", "情绪板", "主视觉", "品牌手册", "案例", "样稿", "样张", "提案", "海报", "版式", "模板", "物料")
KEYWORDS_LATIN = (
    "ref", "refs", "reference", "references", "style", "moodboard", "mood", "inspiration", "kv", "vi", "brand",
    "guideline", "guidelines", "deck", "poster", "layout", "template", "lookbook", "design",
)
PICTURES, DOCUMENTS = ("png", "jpg", "jpeg", "webp", "heic", "tif", "tiff"), ("pdf", "pptx", "key")
SKIPPED_NAMES = "(?i)logo|标志|icon|图标|二维码|qrcode|favicon|avatar|头像"
BRAND_SECTIONS = ("资料来源", "品牌色", "Logo", "字体与版式", "视觉风格与禁忌", "对三个方向的约束")
TABLE_ROWS, TABLE_COLUMNS, TITLE_CHARS, KICKER_CHARS = 6, 5, 30, 8


def capacity(spark: SparkSession) -> DataFrame:
    """skeleton, mode, body_cap, strings_cap: twenty rows."""
    rows = [(s, m, *limits) for s, both in CAPACITY.items() for m, limits in zip(("present", "read"), both, strict=True)]
    return spark.createDataFrame(rows, "skeleton string, mode string, body_cap int, strings_cap int")
