import numpy as np
import pyspark.sql.functions as F

from mercanta.llm import residue

RESIDUE = [
    "Marca: {{PRAZO_ENVIO}} | Modelo: undefined", "Disponível em {8} na loja [INSERIR PRECO].", "Preço: R$ __PESO__", "Olá %(titulo)s, seu pedido foi recebido.", "Compre já __LOJA__ com o melhor preço.", "Sobre o produto: [object Object]", "Garantia de *|PESO|* meses",
    "product.detail.cor.label", "Lorem ipsum texto provisório até o time enviar.", "Sumero ordium mixtum marcam ingens.", "asdf asdf teste teste 123", "A página de ofertas requer JavaScript.", "Habilite los scripts en su navegador para continuar", "Turn on JS for this store to proceed.",
    "Página não encontrada.", "Error 404: the requested URL was not found id: ab12", "Traceback: KeyError 'preco' em montar_pagina", "ServiÃ§o temporariamente indisponÃ­vel.", "Confirme que você não é um robô.",
]
TALK = [
    "Tive que habilitar o JavaScript no navegador do trabalho para fechar a compra, fora isso gostei.", "O curso de JavaScript que veio de brinde é durável.", "O teclado grava macros: segure {Fn} + {F9} e digite.", "A Jacuma Nullus tem modelo undefined?", "Aparece 'página não encontrada' quando leio o QR code da caixa.",
    "Uso $HOME/midia e %TEMP% como pastas e nunca falhou.", "Exportei o perfil como {\"dpi\": 800, \"luz\": \"azul\"} e funcionou.", "Imprimi uma página de lorem ipsum para testar e a cor saiu ótima.", "[NOVO] [ORIGINAL] mouse Quintra com envio rápido.", "Hoje 9 consultas voltaram 200 e 3 pararam no captcha.", "Modelo JS-98517, medidas de 6 x 46 cm.", "", None,
]


def _found(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, passage string")
    return {r.doc_id for r in residue.residue_documents(df).collect()}


def test_each_kind(spark):
    texts = [f"Bom produto, chegou no prazo. {t}\nRecomendo." for t in RESIDUE] + TALK
    assert _found(spark, texts) == set(range(len(RESIDUE)))


def test_signs_in_other_words(spark):
    residue_texts = ["502 Bad Gateway nginx", "Dear [FIRST_NAME], your order {order-id} has shipped.", "This page no longer exists.", "You are using an outdated browser.", "Vestibulum habitant morbis tristitiam senectus netus fames.", "xyz xyz xyz xyz", "Resposta com status 404 id ab"]
    honest = ["minha filha acessa paginas com javascript ativado", "Resposta boa: 3 de 4.", "The shop said 'page not found' once.", "Veio com cabos, pilhas e manual."]
    assert _found(spark, residue_texts + honest) == set(range(len(residue_texts)))


def test_missing_values_count_where_a_template_had_a_slot(spark):
    """No sign is in the texts 1 and 2: they are found by what stands beside the slots of text 0."""
    texts = ["Garantia de {{meses}} meses pela Nullus.", "Garantia de NaN meses pela Nullus.", "Ótimo. garantia de undefined meses pela loja", "O adesivo diz NaN Sound e agrada.", "Garantia de 12 meses pela Nullus."]
    assert _found(spark, texts) == {0, 1, 2}


def test_near_copies_are_found_by_their_likeness(spark):
    known = "Seu acesso foi bloqueado pela equipe de seguranca"
    typo = known.replace("foi bloqueado", "foi bloqeuado")
    further = typo.replace("equipe de", "equipa da")
    mixed = "Preço: R$ [object Object] o acabamento em nylon trancado deixa este conjunto bonito, leve e muito pratico para viagens longas"
    honest = mixed.removeprefix("Preço: R$ [object Object] ")
    assert _found(spark, [known, typo, mixed, honest, "Texto honesto sobre um mouse.", further]) == {0, 1, 2, 5}


def test_copies_long_and_empty(spark):
    long = "Ideal para viagens. " * 5000 + "{{preco}}"
    assert _found(spark, [long, "Página não encontrada."] + ["Página não encontrada."] * 50 + ["Ideal para viagens."]) == set(range(52))
    assert _found(spark, []) == set()


def test_simhash():
    texts = ["o servidor nao respondeu, tente mais tarde", "o servidor nao respondeu, tente mais tarde!", "cabo hdmi de dois metros com malha", "ab", ""]
    h = residue.simhash(texts)
    apart = lambda a, b: bin(int(h[a] ^ h[b])).count("1")
    assert apart(0, 1) <= 10 < apart(0, 2) and len(h) == 5 and (residue.simhash(texts) == h).all() and len(residue.simhash([])) == 0
    assert h.dtype == np.uint64


def test_clean_and_found_part_the_table(spark, data):
    n = spark.read.parquet(f"{data}/documents.parquet").count()
    found = residue.residue_documents(spark.read.parquet(f"{data}/documents.parquet")).agg(F.count("*").alias("n")).first().n
    assert residue.clean_documents(spark, data).count() == n - found


def test_spreading_reaches_what_brute_force_reaches(spark):
    """Components against brute force: links of nine in ten bands of likeness are met, and chains of them lead on."""
    words = "conexao pagina servidor tempo acesso pedido painel cliente janela motivo retorno limite sistema grupo volume rede turno campo modelo folha".split()
    rng = np.random.default_rng(7)
    seeds = [" ".join(rng.choice(words, size=6)) for _ in range(60)]
    texts = {s: 1 for s in seeds}
    for s in seeds:
        for edits in range(1, 10):
            t = list(s)
            for at in rng.integers(3, len(t), size=edits):
                t[at] = "qwxyk"[rng.integers(5)]
            texts.setdefault("".join(t), 0)
    rows = spark.createDataFrame(list(texts.items()), "unit string, label int")
    got = {r.unit for r in residue.spread(residue.fingerprinted(rows)).collect()}
    alike = lambda a, b: 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)) >= 0.8 - 1e-9
    want, last = set(seeds), set()
    while want != last:
        last, labelled = want, spark.createDataFrame([(w,) for w in want], "seed string")
        want = want | {r.unit for r in rows.crossJoin(labelled).where(alike(F.col("unit"), F.col("seed"))).select("unit").distinct().collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(got) > len(seeds) + 200
