"""A workbook of seven sheets as seven tables."""

import zipfile
from datetime import date
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from pricewright.functions import dates, identity
from pricewright.operators import workbook
from pricewright.sources import feeds

M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def write(path, sheets):
    def cell(v, at):
        if v is None:
            return ""
        return f'<c r="{at}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{at}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'

    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f"<workbook {M} {R}><sheets>{names}</sheets></workbook>")
        links = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{k + 1}">' + "".join(cell(v, f"{chr(65 + j)}{k + 1}") for j, v in enumerate(row)) + "</row>" for k, row in enumerate(rows))
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {M}><sheetData>{body}</sheetData></worksheet>")


def test_seven_sheets_give_seven_tables(spark, tmp_path):
    code = lambda n: f"{n:018d}"
    write(tmp_path / "a.xlsx", {
        "items before their lists": [["Код списка", "Название", "Код товара", "Значение"], ["L1", None, 101, "5,5"], [None, "Вторая", 102, 7], ["L1", None, 101, 6], ["L1", None, 999, 1], ["нет", None, 101, 1]],
        "prices": [["Код ЦФ", "Product_code", "Источник", "Поставщик", "Дата", "Цена"], ["F1", 101, "s1", "sup", "31.12.2024", "10,5"], ["F1", 101, "s1", None, 45658, 11], ["F9", 101, "s1", None, None, 1], ["F1", 102, "s2", None, "bad", "x"]],
        "a title above": [["Отчёт за месяц"], [None], ["Код", "Наименование", "Себестоимость"], [101, "Первый", "1 000,5"], [101, "Первый снова", 2], [None, "no code", 1], [102, None, None]],
        "formats": [["Код  ЦФ", "Филиал", "Наименование", "Прогиб"], ["F1", "Алматы", "Один", "0,5"], ["F1", None, "Один снова", None], ["F2", None, None, None]],
        "ranges": [["Код ЦФ", "Стоимость от", "Стоимость до", "Наценка"], ["F1", 0, 100, 15], ["F1", 0, 100, 0.2], ["F1", 100, None, 10], ["F7", 0, 1, 1], ["F2", "x", 1, 1]],
        "lists": [["Код", "Название", "Тип", "Статус", "Дата начала", "Код ЦФ"], ["L1", "Первая", "fixed", "активен", "2024-01-02", "F1"], [None, "Вторая", "min", None, "03/02/2024", "F7"], [None, "Первая", "fixed", "Не активный", None, None]],
        "sources": [["код цф ", "Источник", "Коэффициент", "Поставщик", "Код ЦФ"], ["F3", "s1", "0,9", "x", "F1"], ["F3", "s1", None, None, "F1"], ["F1", "s1", 1, None, "F3"]],
        "other": [["what", "ever"], [1, 2]],
    })
    rows = feeds.read_xlsx(spark, str(tmp_path / "a.xlsx"), workbook.WORDS)
    got = {k: sorted((tuple(r) for r in v.collect()), key=str) for k, v in workbook.load(rows).items()}
    assert got == {
        "price_formats": [("F1", "Один снова", "Алматы", 0.5), ("F2", "F2", None, None)], "products": [(code(101), "Первый снова", 2.0), (code(102), code(102), 0.0)],
        "markup_ranges": [("F1", 0.0, 100.0, 0.2), ("F1", 100.0, None, 0.1)],
        "universal_lists": [("L1", "L1", "Первая", "fixed", "Не активный", None, None, None), ("Вторая|min", None, "Вторая", "min", "Не активный", date(2024, 2, 3), None, None)],
        "list_items": [("L1", code(101), 6.0), ("Вторая|min", code(102), 7.0)], "competitor_sources": [("F1", "s1", 1.0, "x")],
        "competitor_prices": [("F1", code(101), "s1", "sup", date(2025, 1, 1), 11.0), ("F1", code(102), "s2", None, None, None)],
    }
    more = workbook.load(rows, {"price_formats": spark.createDataFrame([("F7",)], "code string"), "products": spark.createDataFrame([(code(999),)], "code string")})
    assert more["markup_ranges"].where("format = 'F7'").count() == 1 and more["list_items"].where(F.col("product") == code(999)).count() == 1


def test_dates_of_cells_and_names_of_cities(spark):
    x = spark.createDataFrame([("2024-02-01",), ("01.02.2024",), ("01/02/2024",), ("45323",), ("45323.0",), ("soon",), (None,)], "c string")
    assert [r[0] for r in x.select(dates.cell_date(F.col("c"))).collect()] == [date(2024, 2, 1)] * 5 + [None, None]
    y = spark.createDataFrame([("Нур-Султан",), ("Нурсултан",), (" Орал",), ("Уральск",), ("Нигде",)], "c string")
    assert [r[0] for r in y.select(identity.city_id(F.col("c"))).collect()] == [2, 2, 15, 15, None]
