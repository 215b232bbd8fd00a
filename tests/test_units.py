from mercanta.operators.units import common_units

CASES = {
    "13 vendidos": 13, "+ de 46 unidades vendidas": 46, "Mais de 1.439 vendidos": 1439, "3.605 vendidos": 3605, "Vendidos: 4.082": 4082, "1,1 mil+ vendidos": 1100, "1.2 mil unid. vendidas": 1200, "1K vendidos": 1000, "2,6M sold": 2600000,
    "1,3 mi vendidos": 1300000, "+3,2 milhões de vendas": 3200000, "2.9 milhÃµes vendidos": 2900000, "13,5 dz vendidas": 162, "½ dúzia vendida": 6, "1⁄2 DUZIA VENDIDA": 6, "Â½ dÃºzia vendida": 6, "meia dúzia já vendida": 6, "uma dÃºzia vendida": 12,
    "3 doz sold": 36, "2 ct vendidos": 200, "Vendidos 2 centos": 200, "4 grosas vendidas": 576, "2 mlh. vendidos": 2000, "+2 milheiros vend.": 2000, "9 prs vend.": 18, "+77 pares vendidos": 154, "2 caixas c/ 50 un vendidas": 100, "29 pcts de 6 vend.": 174,
    "2 x 24 un vendidas": 48, "vendidos 3 fardos de 24 unidades": 72, "2 cx (50 pç cada) vendidas": 100, "19 kits com 6 peças vendidos": 114, "JÃ¡ foram 2072 vendas": 2072, "267 compras no mês passado": 267, "26\xa0UN. VENDIDAS": 26,
}
NONE = ["Vendido e entregue por Casa do Cabo 24", "Novo", "Mais vendido", "1º mais vendido em Informática", "estoque: 4 dz", "restam 13 unidades", "lote mínimo 50 un", "venda por quilo", "", None, "1O MAIS VENDIDO EM INFORMATICA"]


def test_every_form_and_no_false_ones(spark):
    rows = [(str(i), "s", t, q if i % 2 else None) for i, (t, q) in enumerate(CASES.items())] + [(f"n{i}", "s", t, 3) for i, t in enumerate(NONE)]
    out = {r.key: r.units_sold for r in common_units(spark.createDataFrame(rows, "id string, s string, t string, q int"), "id", "s", "t", "q").collect()}
    assert out == {str(i): q for i, q in enumerate(CASES.values())}


def test_the_data_choose_an_ambiguous_unit(spark):
    """In one source a mark parts thousands beside k and m means thousand; wrong quantities don't sway it."""
    rows = [(f"a{i}", "a", f"{i}m sold", i * 1000 if i % 3 else i) for i in range(2, 60)] + [(f"b{i}", "b", f"{i}m sold", i * 1000000 if i % 3 else i) for i in range(2, 60)]
    out = common_units(spark.createDataFrame(rows, "id string, s string, t string, q int"), "id", "s", "t", "q").collect()
    assert {(r.source, r.factor, r.is_unique) for r in out} == {("a", 1e3, True), ("b", 1e6, True)}


def test_nothing_to_fit(spark):
    df = spark.createDataFrame([("1", None, "2 ct vendidos", None), ("2", None, "2 ct vendidos", None), ("2", None, "2 ct vendidos", -4)], "id string, s string, t string, q int")
    assert [(r.units_sold, r.is_unique) for r in common_units(df, "id", "s", "t", "q").collect()] == [(200, False)] * 3
    assert common_units(df.limit(0), "id", "s", "t", "q").count() == 0
