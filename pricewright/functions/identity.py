"""Names of competitors, branches, sources and lists: canonical forms, codes and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alias families (canonical, shown, legal prefix), regions, branches, aliases of branches and of list types, markers.
FAMILIES = (("аманат", "Аманат", None), ("медсервис", "Медсервис", None), ("атамирас", "Атамирас", "атамирас тоо"), ("зерде", "Зерде", "зерде тоо нпо"), ("стофарм", "Стофарм", None))
REGIONS = ("актау", "актобе", "алматы", "астана", "атырау", "караганда", "костанай", "кызылорда", "павлодар", "семей", "тараз", "уральск", "усть-каменогорск", "шымкент")
BRANCHES = {"1": "Алматы", "2": "Астана", "3": "Актау", "4": "Актобе", "5": "Атырау", "6": "Караганда", "8": "Костанай", "9": "Кызылорда", "10": "Павлодар", "11": "Петропавловск", "13": "Талдыкорган", "15": "Уральск", "16": "Усть-Каменогорск", "17": "Шымкент"}
# Other names of cities.
CITIES = {"Нур-Султан": "2", "Нурсултан": "2", "Орал": "15"}
BRANCH_ALIASES = {
    "almaty": "1", "astana": "2", "nur-sultan": "2", "nursultan": "2", "aktau": "3", "aktobe": "4", "atyrau": "5", "karaganda": "6", "kostanay": "8", "kyzylorda": "9",
    "pavlodar": "10", "petropavlovsk": "11", "taldykorgan": "13", "uralsk": "15", "oral": "15", "ust-kamenogorsk": "16", "shymkent": "17",
}
LIST_TYPES = {
    "фиксированная цена": "fixed_price", "минимальная цена": "min_price", "максимальная цена": "max_price", "минимальная наценка": "min_markup", "критическая наценка": "critical_markup", "максимальная наценка": "max_markup",
    "исключить из переоценки": "exclude_from_pricing", "без прогиба": "no_bend", "меморандум": "memorandum", "exclusion": "exclude_from_pricing", "markup": "fixed_markup",
}
MULTI_PRICE = ("emit", "amity", "эмити")
INACTIVE = ("inactive", "disabled", "archived", "неактивный", "не активный", "архивный")
ACTIVE = ("active", "enabled", "активен", "активный")


def _map(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def competitor_text(c: Column) -> Column:
    """Lower case, ё as е, no blanks around brackets and commas, single spaces."""
    low = F.translate(F.lower(F.trim(F.coalesce(c, F.lit("")))), "ё", "е")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"\s*([(),])\s*", "$1"), r"(?U)\s+", " "))


def competitor(name: Column, supplier: Column | None = None, shown: Column | None = None) -> Column:
    """The canonical name of a family for its name, its name with a region in brackets and its legal name; else the text."""
    raw = F.coalesce(*[F.nullif(c, F.lit("")) for c in (name, supplier, shown) if c is not None])
    t = competitor_text(raw)
    legal = {x: c for c, _, x in FAMILIES if x}
    before = F.regexp_extract(t, rf"^({'|'.join(legal)})(?:[( ].*)?$", 1)
    return F.coalesce(_map({c: c for c, _, _ in FAMILIES}, F.regexp_replace(t, r"^([^(]*)\(.*\)$", "$1")), _map(legal, before), t)


def shown_name(canonical: Column, fallback: Column) -> Column:
    names = {c: s for c, s, _ in FAMILIES}
    return F.coalesce(_map(names, competitor_text(canonical)), F.trim(F.coalesce(F.nullif(fallback, F.lit("")), canonical, F.lit(""))))


def obsolete_names(canonical: Column) -> Column:
    """The spellings that a canonical name replaces, in order; none for what is no family."""
    out = F.array().cast("array<string>")
    for c, _, legal in FAMILIES:
        names = sorted([f"{c}({r})" for r in REGIONS] + ([legal] if legal else []))
        out = F.when(competitor_text(canonical) == c, F.array(*map(F.lit, names))).otherwise(out)
    return out


def branch_id(c: Column) -> Column:
    """Id, name or alias of a branch as its id; what is none comes back trimmed."""
    t = F.trim(F.coalesce(c, F.lit("")))
    key = F.regexp_replace(F.lower(t), r"(?U)\s+", " ")
    number = F.when(t.rlike(r"^\d+$"), F.regexp_replace(t, r"^0+(?=.)", ""))
    by_name = {v.lower(): k for k, v in BRANCHES.items()}
    return F.coalesce(F.when(number.isin(*BRANCHES), number), _map(BRANCH_ALIASES, key), _map(by_name, key), t)


def city_id(name: Column) -> Column:
    return _map({**{v: k for k, v in BRANCHES.items()}, **CITIES}, F.trim(name)).cast("int")


def list_type(c: Column) -> Column:
    """The code of a list type for its label in any case; codes and unknown types stay."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.coalesce(_map(LIST_TYPES, F.lower(t)), t)


def is_active(status: Column) -> Column:
    """By the list of active and inactive words; of others whether they begin with an active one."""
    t = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    begins = F.lit(False)
    for w in ACTIVE:
        begins = begins | t.startswith(w)
    return F.when(t.isin(*INACTIVE), False).when(t.isin(*ACTIVE), True).otherwise(begins)


def is_multi_price(ids: Column | None, allowed: tuple[str, ...], *names: Column) -> Column:
    """An id of the configured ones, or a marker in one of the names."""
    text = F.lower(F.concat_ws(" ", *names))
    found = F.lit(False)
    for m in MULTI_PRICE:
        found = found | F.contains(text, F.lit(m))
    return found if ids is None else found | F.trim(ids.cast("string")).isin(*allowed)


def percentile_mode(source_type: Column, configured: Column, *names: Column) -> Column:
    """The configured mode, else ``multi_price`` for such sources, else empty."""
    own = F.nullif(F.trim(F.coalesce(configured, F.lit(""))), F.lit(""))
    default = F.when((F.lower(F.trim(source_type)) == "emit") | is_multi_price(None, (), *names), "multi_price").otherwise("")
    return F.coalesce(own, default)


def source_key(key: Column, source_type: Column, account: Column, external: Column, branch: Column, multi: Column) -> Column:
    """A stable id of a source: its own key, else by type from account, list and branch."""
    k, t, a, x, b = (F.trim(F.coalesce(c.cast("string"), F.lit(""))) for c in (key, source_type, account, external, branch))
    t = F.lower(t)
    has_x, has_a = x != "", a != ""
    return (
        F.when(k != "", k).when(has_x & ((t == "emit") | multi), F.concat(F.lit("emit:"), x)).when((t == "provisor") & has_a & has_x, F.concat(F.lit("account:"), a, F.lit(":plk:"), x))
        .when((t == "provisor") & has_x, F.concat(F.lit("plk:"), x)).when((t == "vidman") & has_a & has_x, F.concat(a, F.lit(":"), x)).when((t == "manual") & has_x, F.concat(F.lit("manual:"), x))
        .when((t != "") & has_a & (b != ""), F.concat_ws(":", t, a, b)).otherwise("")
    )


def mapping_text(c: Column) -> Column:
    """Lower case, ё as е; letters of Latin and Cyrillic and digits, single spaces."""
    low = F.translate(F.lower(F.trim(F.coalesce(c, F.lit("")))), "ё", "е")
    return F.trim(F.regexp_replace(low, r"[^0-9a-zа-я]+", " "))


def match_key(platform: Column, external: Column, name: Column, maker: Column) -> Column:
    """``platform:id``, else the platform with name and maker."""
    p, x = F.lower(F.trim(platform)), F.trim(F.coalesce(external.cast("string"), F.lit("")))
    return F.when(x != "", F.concat(p, F.lit(":"), x)).otherwise(F.concat(p, F.lit(":name:"), mapping_text(name), F.lit("|manufacturer:"), mapping_text(maker)))


def percentile_source(kind: Column, fmt: Column, scope: Column, key: Column, region: Column, rival: Column, level: Column) -> Column:
    """``[competitor:]format:scope:key:region:competitor:pNN``; multi-price sources have no prefix."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    base = F.concat_ws(":", part(fmt), part(scope), part(key), part(region), part(rival), F.concat(F.lit("p"), level.cast("int").cast("string")))
    return F.when(kind == "emit", base).otherwise(F.concat(F.lit("competitor:"), base))


def parsed_source(name: Column, fmt: Column, scope: str = "regular_competitor") -> Column:
    """struct<identity, percentile> of ``percentile:competitor:<format>:<scope>:...``; null for other names."""
    prefix = F.concat(F.lit("percentile:competitor:"), fmt.cast("string"), F.lit(f":{scope}:"))
    rest = F.substr(name, F.length(prefix) + 1)
    before, level = F.regexp_extract(rest, r"^(.*):p(\d+)$", 1), F.regexp_extract(rest, r":p(\d+)$", 1)
    identity = competitor(F.trim(F.split(before, "::")[0]))
    return F.when(F.startswith(name, prefix) & (level != "") & (identity != ""), F.struct(identity.alias("identity"), level.cast("int").alias("percentile")))


def pretty_source(c: Column) -> Column:
    """``provisor:7`` as ``Provisor 7``, ``phcenter:x`` as ``Фармцентр x``; manual and percentile sources without their prefix."""
    rest = F.regexp_replace(c, r"^[^:]*:", "")
    return F.when(c.startswith("provisor:"), F.concat(F.lit("Provisor "), rest)).when(c.startswith("phcenter:"), F.concat(F.lit("Фармцентр "), rest)).when(c.startswith("manual:") | c.startswith("percentile:"), rest).otherwise(c)


def source_type(c: Column) -> Column:
    return F.substring_index(c, ":", 1)


def calculation_log(reason: Column, rivals: Column, source: Column, rank: Column, markup: Column, overridden: Column, first: Column | None = None) -> Column:
    """Why a product has its price, in a sentence. ``rivals``: how many competitor prices there were; ``markup``: a fraction; ``first``: the source of the lowest price."""
    none = F.when(overridden, "Нет цен выбранных конкурентов. Применена шкала маржи для товаров без конкурентов с учетом Lists Management.").otherwise("Нет цен выбранных конкурентов. Применена глобальная шкала маржи для товаров без конкурентов.")
    percent = F.concat(F.lit("Цена рассчитана по основной шкале наценки: "), (markup * 100).cast("decimal(18,2)").cast("string"), F.lit("%."))
    return (
        F.when(F.coalesce(rivals, F.lit(0)) == 0, none)
        .when(reason.isin("competitor", "competitor_bend", "competitor_bend_c1"), F.concat(F.lit("Цена рассчитана относительно "), F.coalesce(rank, F.lit(1)).cast("string"), F.lit("-й цены конкурента "), pretty_source(source), F.lit(".")))
        .when(reason == "all_competitors_failed_mdc", "Ни одна цена конкурентов не прошла условие минимальной допустимой цены. Применена минимальная наценка.")
        .when(reason == "no_competitor_markup_bumped_to_mdc", "Нет цен выбранных конкурентов. Цена по шкале без конкурентов ниже МДЦ, применена МДЦ.")
        .when(reason == "mdc_floor_after_competitor", F.concat(F.lit("Цена установлена по минимальной наценке, так как первая цена конкурента "), pretty_source(source if first is None else first), F.lit(" не прошла условие минимальной допустимой цены.")))
        .when(reason == "mdc_floor_after_rounding", "Цена поднята до МДЦ после округления или ограничений.")
        .when(reason == "min_margin_floor", "Цена поднята до минимальной наценки.").when(reason == "max_margin_cap", "Цена ограничена максимальной наценкой.")
        .when(reason == "fixed_price_list", "Финальная цена установлена напрямую из фиксированной цены; выбор конкурента и прогиб не применялись.").otherwise(percent)
    )
