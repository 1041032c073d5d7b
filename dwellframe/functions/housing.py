"""Parsing and derivation of housing attributes from feed text."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellframe.functions.numbers import (
    clip, digits_to_double, known_number, round_half_even, to_double)
from dwellframe.functions.text import first_match
from dwellframe.schema import DISTRICT_BY_CODE, DISTRICT_BY_CODE_B, SOURCE_A, SOURCE_B
from dwellframe.schema import (
    DECORATION_CODES, DISTRICT_TIERS, FLOOR_CODES, OTHER_TIER)

# Text patterns of the feeds.
ROOMS, HALLS, BATHS = "([0-9]+)室", "([0-9]+)厅", "([0-9]+)卫"
FLOOR_LIST = "(低层|中层|高层)"
FLOOR_DETAIL = "(低层|中层|高层|低楼层|中楼层|高楼层)"
TOTAL_FLOORS = "共([0-9]+)层"
TOTAL_FLOORS_LOOSE = r"共\s*([0-9]+)\s*层"
YEAR, YEAR_BUILT = "([0-9]{4})年", "([0-9]+)年建造"
DECORATIONS = "(精装修|精装|简装|毛坯|豪装)"
KEYWORD_BATHS = "[0-9]+室[0-9]+厅([0-9]+)卫"
KEYWORD_UNIT = r"([0-9.]+)\s*元/平米"
COORD_META = "coord=([0-9.]+),([0-9.]+)"
COORD_JSON = r'(?s)"longitude":\s*([0-9.]+).*?"latitude":\s*([0-9.]+)'
PRICE_IN_TITLE = r"([0-9]+\.?[0-9]*)\s*[万Ww]"
ALT_COMMUNITY = "^(.+?)[0-9]+室"
TITLE_COMMUNITY = r"^\S+\s+(.+?)\s+[一二三四五六七八九0-9]+房"


def count_before(text: Column, pattern: str) -> Column:
    """Whole number in the pattern's group, 0 when absent ('' is ruled out first because a failing parse is slow)."""
    return F.coalesce(first_match(text, pattern).try_cast("int"), F.lit(0))


def layout_struct(layout: Column) -> Column:
    """'3室2厅1卫' -> rooms, halls, bathrooms; absent parts are 0."""
    return F.struct(
        count_before(layout, ROOMS).alias("rooms"),
        count_before(layout, HALLS).alias("halls"),
        count_before(layout, BATHS).alias("bathrooms"),
    )


def floor_type(text: Column, wide: bool = False, normalise: bool = False) -> Column:
    """Storey class named in the text.

    List pages know three classes, detail pages also the '…楼层' spellings
    (``wide``). ``normalise`` folds the long spelling into the short one.
    """
    found = F.regexp_extract(text, FLOOR_DETAIL if wide or normalise else FLOOR_LIST, 1)
    return F.regexp_replace(found, "楼层", "层") if normalise else found


def total_floors(text: Column, loose: bool = False) -> Column:
    return count_before(text, TOTAL_FLOORS_LOOSE if loose else TOTAL_FLOORS)


def build_year(text: Column, built: bool = False) -> Column:
    return count_before(text, YEAR_BUILT if built else YEAR)


def area_number(text: Column) -> Column:
    return F.coalesce(known_number(F.btrim(F.regexp_replace(text, "平米|㎡|m²", ""))), F.lit(0.0))


def split_info(info: Column) -> Column:
    """Parts of a '|'-separated info line, trimmed."""
    return F.split(F.btrim(info), r"\s*\|\s*")


def info_struct(parts: Column) -> Column:
    """Parts 'layout|area|orientation|decoration|floor|year' as typed fields.

    ``parts`` is used once per field: pass a column made by ``split_info``.
    """

    def part(i: int) -> Column:
        return F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))

    layout, floor = part(1), part(5)
    return F.struct(
        layout.alias("layout"),
        count_before(layout, ROOMS).alias("rooms"),
        count_before(layout, HALLS).alias("halls"),
        count_before(layout, BATHS).alias("bathrooms"),
        area_number(part(2)).alias("area"),
        part(3).alias("orientation"),
        part(4).alias("decoration"),
        floor.alias("floor_desc"),
        floor_type(floor).alias("floor_type"),
        total_floors(floor).alias("total_floors"),
        build_year(part(6)).alias("build_year"),
    )


def keywords_struct(content: Column) -> Column:
    """Keyword list of a detail page -> bathrooms, unit price, year, decoration."""
    return F.struct(
        count_before(content, KEYWORD_BATHS).alias("bathrooms"),
        to_double(first_match(content, KEYWORD_UNIT), 0.0).alias("unit_price"),
        build_year(content).alias("build_year"),
        F.regexp_extract(content, DECORATIONS, 1).alias("decoration"),
    )


def coordinates(text: Column) -> Column:
    """``coord=x,y`` first, then a JSON longitude/latitude pair; null when absent."""
    def axis(group: int) -> Column:
        return F.coalesce(to_double(first_match(text, COORD_META, group)),
                          to_double(first_match(text, COORD_JSON, group)))
    return F.struct(axis(1).alias("lng"), axis(2).alias("lat"))


def detail_floor_struct(page_text: Column) -> Column:
    """Storey text of a detail page: class followed by total, else either alone."""
    pair = F.nullif(
        F.regexp_extract(page_text, FLOOR_DETAIL + ".*?" + TOTAL_FLOORS_LOOSE, 0), F.lit(""))
    alone = F.regexp_extract(page_text, FLOOR_DETAIL, 1)
    return F.struct(
        F.coalesce(pair, alone).alias("floor_desc"),
        F.regexp_extract(F.coalesce(pair, page_text), FLOOR_DETAIL, 1).alias("floor_type"),
        F.when(pair.isNotNull(),
               count_before(pair, ".*" + TOTAL_FLOORS_LOOSE))
        .otherwise(total_floors(page_text, loose=True)).alias("total_floors"),
    )


def community_from(alt: Column, title: Column) -> Column:
    """Community from an image's alt text, else from the title's middle words."""
    return F.coalesce(first_match(alt, ALT_COMMUNITY), first_match(title, TITLE_COMMUNITY), F.lit(""))


def price_from_title(title: Column) -> Column:
    return known_number(F.regexp_extract(title, PRICE_IN_TITLE, 1))


def first_price(*candidates: Column) -> Column:
    """First non-blank price text decides; a result of zero falls to the last candidate (title)."""
    *texts, title = candidates
    text = F.coalesce(*[F.nullif(F.btrim(t), F.lit("")) for t in texts])
    value = F.coalesce(digits_to_double(text), F.lit(0.0))
    return F.when(value > 0, value).otherwise(
        F.coalesce(known_number(F.regexp_extract(title, r"([0-9]+\.?[0-9]*)\s*万", 1)), F.lit(0.0)))


def unit_from_total(total: Column, area: Column) -> Column:
    return round_half_even(total * 10000.0 / area, 2)


def repair_prices(df: DataFrame, total: str, unit: str, area: str, title: str, touch: Column) -> DataFrame:
    """Undo unit damage in the total price of the ``touch`` rows; adds ``repair_rule``.

    Rules: ``invalid`` (not positive), ``kept``, ``unit`` (unit price off by
    more than five times), ``title`` (price named in the title, 3 to 3000),
    ``divided`` (by 100,000 from ten million up, else by 10,000) and
    ``divided_other`` (by the other divisor when the first leaves the price
    above 5000). Steps are separate projections so that every rounded quantity
    is computed once.
    """
    c = F.col
    large = c("_t") >= 1e7
    df = df.withColumns({
        "_t": F.coalesce(c(total), F.lit(0.0)), "_touch": touch,
        "_tt": F.coalesce(price_from_title(c(title)), F.lit(0.0)),
    })
    df = df.withColumns({
        "_a": c("_t") / F.when(large, 1e5).otherwise(1e4),
        "_b": c("_t") / F.when(large, 1e4).otherwise(1e5),
        "_titled": (c("_tt") >= 3) & (c("_tt") <= 3000),
        "_high": c("_t") > 1000,
    })
    df = df.withColumns({"_a": round_half_even(c("_a"), 4), "_b": round_half_even(c("_b"), 4),
                         "_tr": round_half_even(c("_tt"), 2)})
    df = df.withColumn("_ok", (c("_a") > 0) & (c("_a") <= 5000))
    df = df.withColumns({
        "_new": F.when(~c("_high"), c("_t")).when(c("_titled"), c("_tr"))
                 .when(c("_ok"), c("_a")).otherwise(c("_b")),
        # The title price feeds the unit price before it is rounded itself.
        "_per": F.when(c(area) > 0, F.when(~c("_high"), c("_t")).when(c("_titled"), c("_tt"))
                       .when(c("_ok"), c("_a")).otherwise(c("_b")) * 10000.0 / c(area)),
    })
    df = df.withColumn("_per", round_half_even(c("_per"), 2))
    known = F.coalesce(c(unit), F.lit(0.0))
    off = F.coalesce((known > 0) & ((known > c("_per") * 5) | (known < c("_per") / F.lit(5.0))), F.lit(False))
    df = df.withColumn("repair_rule",
                       F.when(~c("_touch"), "kept").when(c("_t") <= 0, "invalid")
                       .when(~c("_high") & off, "unit").when(~c("_high"), "kept")
                       .when(c("_titled"), "title").when(c("_ok"), "divided").otherwise("divided_other"))
    keep_unit = c("repair_rule").isin("invalid", "kept") | c("_per").isNull()
    df = df.withColumns({
        total: F.when(c("_touch"), c("_new")).otherwise(c("_t")),
        unit: F.when(keep_unit, c(unit)).otherwise(c("_per")),
    })
    return df.drop("_t", "_tt", "_tr", "_touch", "_a", "_b", "_titled", "_high", "_ok", "_new", "_per")


def price_was_fixed(before: Column, after: Column) -> Column:
    return F.abs(before - after) > 1


def complete_unit_price(unit: Column, total: Column, area: Column) -> Column:
    """Derive a missing unit price from total price and area."""
    missing = F.coalesce(unit, F.lit(0.0)) == 0
    return F.when(missing & (area > 0) & (total > 0), unit_from_total(total, area)).otherwise(unit)


def complete_bathrooms(baths: Column, layout: Column, rooms: Column) -> Column:
    """Missing bathrooms: from the layout text, else one up to two rooms, else two."""
    return (
        F.when(F.coalesce(baths, F.lit(0)) != 0, baths)
        .when(F.regexp_extract(layout, BATHS, 1) != "", count_before(layout, BATHS))
        .when(F.coalesce(rooms, F.lit(0)) <= 2, F.lit(1))
        .otherwise(F.lit(2))
    )


def code_of(c: Column, codes: dict[str, int], default: int = 1) -> Column:
    lookup = F.create_map(*[F.lit(v) for v in chain.from_iterable(codes.items())])
    return F.coalesce(F.try_element_at(lookup, c), F.lit(default))


def floor_code(c: Column) -> Column:
    return code_of(c, FLOOR_CODES)


def decoration_code(c: Column) -> Column:
    return code_of(c, DECORATION_CODES)


def orientation_code(c: Column, corrected: bool = False) -> Column:
    """South 3, east or west 1, else 0.

    In the original order the south-east/south-west class (2) is shadowed by
    the test for south; ``corrected`` tests it first.
    """
    text = F.coalesce(c, F.lit(""))
    south = text.contains("南")
    slanted = text.contains("东南") | text.contains("西南")
    side = text.contains("东") | text.contains("西")
    chain_ = F.when(slanted, 2).when(south, 3) if corrected else F.when(south, 3).when(slanted, 2)
    return chain_.when(side, 1).otherwise(0)


def house_age(year: Column, as_of_year: int) -> Column:
    return clip(F.lit(as_of_year) - year, 0, 50)


def area_per_room(area: Column, rooms: Column, halls: Column, baths: Column) -> Column:
    return clip(area / clip(rooms + halls + baths, 1, 20), 5.0, 100.0)


def district_tier(name: Column) -> Column:
    tier, pages = F.lit(OTHER_TIER[0]), F.lit(OTHER_TIER[1])
    for label, budget, names in reversed(DISTRICT_TIERS):
        tier = F.when(name.isin(names), label).otherwise(tier)
        pages = F.when(name.isin(names), budget).otherwise(pages)
    return F.struct(tier.alias("tier"), pages.alias("max_pages"))


def bin_label(c: Column, bins: tuple[list[float], list[str]]) -> Column:
    """Half-open bins [edge_i, edge_i+1) with open ends."""
    edges, labels = bins
    out = F.when(c < edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:]):
        out = out.when(c < edge, label)
    return out.otherwise(labels[-1])


def lift_tier(lift: Column) -> Column:
    return (F.when(lift >= 6, "≥6").when(lift >= 4, "≥4").when(lift >= 2, "≥2").otherwise("<2"))


def lift_strength(lift: Column) -> Column:
    return F.when(lift > 2, "strong").when(lift > 1.2, "medium").otherwise("weak")


# Marker colours by unit price.
PRICE_COLOURS = [(10000, "#4CAF50"), (20000, "#8BC34A"), (30000, "#FFEB3B"), (50000, "#FF9800")]
TOP_COLOUR, NO_PRICE_COLOUR = "#F44336", "#999"


def price_colour(unit: Column) -> Column:
    out = F.when(unit.isNull() | (unit <= 0), NO_PRICE_COLOUR)
    for edge, colour in PRICE_COLOURS:
        out = out.when(unit < edge, colour)
    return out.otherwise(TOP_COLOUR)


def with_district_name(df: DataFrame, source: str = "source", code: str = "code", name: str = "name") -> DataFrame:
    """Adds the district's name by the source's own codes; a code without one stands for itself."""
    directory = df.sparkSession.createDataFrame(
        [(s, c, n) for s, codes in ((SOURCE_A, DISTRICT_BY_CODE), (SOURCE_B, DISTRICT_BY_CODE_B)) for c, n in codes.items()],
        "_s string, _c string, _n string")
    # The directory has 50 rows, each code of a source once.
    joined = df.join(F.broadcast(directory), (F.col(source) == F.col("_s")) & (F.col(code) == F.col("_c")), "left")
    return joined.withColumn(name, F.coalesce("_n", code)).drop("_s", "_c", "_n")
