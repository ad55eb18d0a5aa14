"""Golden rows of the rule packs and scalar functions."""

import pytest
from pyspark.sql import functions as F

from caseflow.functions import text as T
from caseflow.operators import classify, match, quality, rules, structure, worklog
from caseflow.packs import labour_br


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("column", "expected"),
    [
        (lambda: T.parse_written_date(F.lit("1 de junho de 2024")), "01/06/2024"),
        (lambda: T.parse_written_date(F.lit("junho de 2024")), None),
        (lambda: T.date_in_format(F.lit("31/02/2024")), True),
        (lambda: T.to_date_br(F.lit("31/02/2024")), None),
        (lambda: T.clean_money(F.lit("R $ 3.093, 10")), "R$ 3.093,10"),
        (lambda: T.date_separators(F.lit("25 / 09 / 2025")), "25/09/2025"),
        (lambda: T.case_number_canonical(F.lit("00012345620245130007")), "0001234-56.2024.5.13.0007"),
        (lambda: T.case_number_canonical(F.lit("123")), None),
        (lambda: T.ordinal_of(F.lit("21a Vara")), None),
        (lambda: T.ordinal_of(F.lit("Segunda Instância")), 2),
        (lambda: T.clean_text(F.lit("em ou tubro  de\n\n\n\nx ")), "em outubro de\n\nx"),
        (lambda: T.clean_identifier(F.lit("CTPS nº 12–3")), "CTPS 12-3"),
        (lambda: T.clean_value(F.lit("  abc  d ;.")), "abc d"),
        (lambda: T.fold(F.lit("  Ação\xa0 Ñ "), "slug"), "acao n"),
        (lambda: T.unit_number(F.lit("Vara Única")), "01"),
        (lambda: T.truthy(F.lit("talvez")), None),
        (lambda: T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), 1.0),
        (lambda: T.person_type(F.lit("Comércio Acme Ltda")), "juridica"),
        (lambda: T.person_type(F.lit("Maria da Silva")), "fisica"),
        (lambda: T.local_time(F.lit("2024-01-01 12:00:00").cast("timestamp")), "01/01/2024 09:00"),
        (lambda: structure.thin_breaks(F.array(*map(F.lit, (0, 50, 190, 260, 900, 1000)))), [0, 260, 900]),
        (lambda: structure.candidate_pages(F.lit(100), F.lit(0.85), F.lit(3), F.lit("ctps")), [83, 85, 87]),
        (lambda: structure.candidate_pages(F.lit(100), F.lit(None).cast("double"), F.lit(0), F.lit("ctps")), [81, 82, 83]),
        (lambda: match.option_score(F.lit("Reclamação Trabalhista"), F.lit("Reclamação Trabalhista")), 100),
        (lambda: match.option_score(F.lit("Reclamação Trabalhista"), F.lit("Reclamação Correicional")), 23),
        (lambda: match.option_score(F.lit("Reclamação Trabalhista"), F.lit("Ação Trabalhista Ordinária")), 17),
        (lambda: match.option_score(F.lit("1ª Instância"), F.lit("Segunda Instância")) < 0, True),
        (lambda: classify.document_type(F.lit(""))["confidence"], 0.0),
        (lambda: classify.document_type(F.lit("Ata de audiência realizada hoje"))["type"], "Ata de Audiência"),
        (lambda: worklog.progress(F.lit(1), F.lit(3)), 33),
        (lambda: worklog.progress(F.lit(0), F.lit(0)), 0),
        (lambda: T.parse_json_array(F.lit('"[\\"a\\"]"')), ["a"]),
        (lambda: T.parse_json_array(F.lit('["a","b"]')), ["a", "b"]),
        (lambda: T.parse_json_array(F.lit('{"q":1}')), []),
        (lambda: T.parse_json_array(F.lit("junk")), []),
    ],
)
def test_functions(spark, column, expected):
    assert value(spark, column()) == expected


CASES = [
    ("Processo 0001234-56.2024.5.13.0007 x", {"case_number": "0001234-56.2024.5.13.0007"}),
    ("Distribuído em 05.03.2024", {"filing_date": "05/03/2024"}),
    ("Valor da causa: R$ 462.289,03", {"claim_value": "462.289,03"}),
    ("salário base: R$ 2.802,3", {"salary": "R$ 2.802,30"}),
    ("Audiência UNA designada em 09/12/2025 às 08:50", {"hearing": "09/12/2025 08:50"}),
    ("PIS/PASEP: 123.45678.90-1", {"pis": "123.45678.90-1"}),
    ("foi demitida sem justa causa", {"dismissal_reason": "Dispensa Sem Justa Causa"}),
    ("ocorreu a demissão sem justa causa", {"dismissal_reason": "Dispensa Sem Justa Causa"}),
    ("demitido por justa causa", {"dismissal_reason": "Dispensa Com Justa Causa"}),
    ("julgo improcedente o pedido", {"decision_result": "Indeferido", "decision_type": "Sentença"}),
    ("Foi admitido em 1 de junho de 2018", {"hire_date": "01/06/2018"}),
    ("data de nascimento e admissão: 01/02/2003", {"hire_date": None}),
    ("piso: o salário de R$ 1.500,00", {"salary": "R$ 1.500,00"}),
    # filing: three ways to say it, one date that is another one's
    ("Protocolado em: 1/02/2024", {"filing_date": None}),
    ("Data da distribuição: 07/02/2024", {"filing_date": "07/02/2024"}),
    ("Autuação em 08-02-2024", {"filing_date": "08/02/2024"}),
    ("Recebida a inicial", {"filing_date": None}),
    ("Recebido em 09/02/2024", {"filing_date": "09/02/2024"}),
    # beginning of employment
    ("foi contratada pela reclamada em 03.04.2019", {"hire_date": "03/04/2019"}),
    ("Começou a trabalhar no dia 05/06/2017", {"hire_date": "05/06/2017"}),
    ("período: 01/02/2015 a 03/04/2016", {"hire_date": "01/02/2015", "dismissal_date": "03/04/2016"}),
    ("carteira de identidade, admissão: 01/02/2003", {"hire_date": None}),
    ("mantém vínculo com a ré desde 10/11/2012", {"hire_date": "10/11/2012"}),
    # end of employment
    ("foi dispensado sem justa causa, em 10/10/2020", {"dismissal_date": "10/10/2020"}),
    ("Data da dispensa: 11.10.2020", {"dismissal_date": "11/10/2020"}),
    ("a rescisão do contrato ocorreu em 12/10/2020", {"dismissal_date": "12/10/2020"}),
    ("demitida em 3 de maio de 2021", {"dismissal_date": "03/05/2021"}),
    ("audiência de 01/01/2021, dispensa: 02/02/2021", {"dismissal_date": None}),
    # pay
    ("percebia mensalmente a quantia de R$ 2.100,50", {"salary": "R$ 2.100,50"}),
    ("recebeu, por último, R$ 1.999,00", {"salary": "R$ 1.999,00"}),
    ("última remuneração foi de R$ 3.000,00", {"salary": "R$ 3.000,00"}),
    ("com salário de R$ 1.234,56", {"salary": "R$ 1.234,56"}),
    ("| Salário | R$ 4.000,00", {"salary": "R$ 4.000,00"}),
    ("multa: o salário de R$ 200,00", {"salary": None}),
    # hearings
    ("audiência inicial, sala 2: 01/02/2024 10:30", {"hearing": "01/02/2024 10:30"}),
    ("Pauta de audiências: 05/02/2024 às 9:15", {"hearing": "05/02/2024 09:15"}),
    ("primeira audiência em 06/02/2024 14:00", {"hearing": "06/02/2024 14:00"}),
    ("audiência de instrução designada para o dia 07/02/2024 11:20", {"hearing": "07/02/2024 11:20"}),
    ("audiência realizada no salão 08/02/2024 11:20", {"hearing": None}),
    ("Designada audiência una para 09-02-2024, às 9h30", {"hearing": "09/02/2024 09:30"}),
    ("Compareça V.Sa. no dia 10.02.2024 às 13:05 à audiência", {"hearing": "10/02/2024 13:05"}),
    ("audiência telepresencial - sala virtual - 11/02/2024 (quinta-feira), 8h05", {"hearing": "11/02/2024 08:05"}),
    ("A sessão de conciliação fica agendada para o dia 12/02/2024, 10:00 horas", {"hearing": "12/02/2024 10:00"}),
    ("audiência de 13/02/2024 foi cancelada; horário 10:00", {"hearing": None}),
    ("audiência em 14/02/2024, em horário a definir", {"hearing": None}),
    # pay, by other words
    ("salário-base no importe de R$ 1.812,00", {"salary": "R$ 1.812,00"}),
    ("auferia proventos de R$ 2.345,67", {"salary": "R$ 2.345,67"}),
    ("remuneração total: R$ 5.000,00", {"salary": "R$ 5.000,00"}),
    ("12. Remuneração mensal R$ 1.900,10", {"salary": "R$ 1.900,10"}),
    ("diferenças devidas: salário de R$ 300,00", {"salary": None}),
    # titles in forms, and what is none
    ("22 Cargo/Função: Analista de Sistemas Matrícula 77", {"job_title": "Analista de Sistemas"}),
    ("Função......... Soldador", {"job_title": "Soldador"}),
    ("Cargo / Função: Operador de Caixa", {"job_title": "Operador de Caixa"}),
    ("laborou na função de eletricista. Elevada ao cargo de supervisora de obras.", {"job_title": "supervisora de obras"}),
    ("cargo: rescisão do contrato", {"job_title": None}),
    ("função de horas extras", {"job_title": None}),
    # places
    ("local de trabalho: Avenida Brasil, 100", {"workplace": "Avenida Brasil, 100"}),
    ("lotada na Rodovia BR 101, km 12", {"workplace": "Rodovia BR 101, km 12"}),
    ("trabalhava em turno de rua", {"workplace": None}),
    ("trabalhou no cargo de motorista na rua", {"workplace": None}),
    # parties: misspelt and rarer labels; of several a company, else the last
    ("SUSCITANTE: Sindicato dos Bancários\nSUSCITADO: Banco Norte S.A.", {"plaintiff": "Sindicato dos Bancários", "defendant": "Banco Norte S.A"}),
    ("CONSIGNANTE: Rui Prado\nCONSIGNADOV: João Souza", {"plaintiff": "Rui Prado", "defendant": "João Souza"}),
    ("RECLAMADO: José Lima\nRECLAMADA: ACME Comércio Ltda\nRECLAMADO: Ana Reis", {"defendant": "ACME Comércio Ltda"}),
    ("RÉU: José Lima\nRÉU: Ana Reis", {"defendant": "Ana Reis"}),
    ("RECLAMADO: PARTES\nRECLAMANTE: ADVOGADO", {"defendant": None, "plaintiff": None}),
    # filing, by other words
    ("Ação ajuizada em 10/02/2024", {"filing_date": "10/02/2024"}),
    ("Data do ajuizamento: 11/02/2024", {"filing_date": "11/02/2024"}),
    ("dá-se à causa o valor de R$ 40.000,00", {"claim_value": "40.000,00"}),
    # registers and cards
    ("inscrito no PIS sob o número 123.45678.90-1", {"pis": "123.45678.90-1"}),
    ("NIT: 12345678901", {"pis": "123.45678.90-1"}),
    ("PASEP/PIS nº 12345678901", {"pis": "123.45678.90-1"}),
    ("PIS: 123.456", {"pis": None}),
    ("CTPS nº 12345, série 001-SP", {"ctps": "12345, série 001-SP"}),
    ("Carteira de Trabalho 12345/001", {"ctps": "12345/001"}),
    ("CTPS digital, CPF 123.456.789-09", {"ctps": "123.456.789-09"}),
    # place
    ("Central de Audiências\n1ª Vara Cível de Campinas, Fórum Trabalhista Rui Barbosa", {"forum": "Fórum Trabalhista Rui Barbosa", "bench": "1ª Vara Cível de Campinas"}),
    ("Célula: Trabalhista Sul", {"cell": "Trabalhista Sul"}),
    ("Comarca de João Pessoa - PB", {"district": "João Pessoa - PB", "state": "PB"}),
    ("Processo 0001234-56.2024.5.13.0007", {"state": "PB"}),
    ("Tribunal Regional do Trabalho da 12ª Região", {"state": "SC"}),
    ("nada consta em Minas Gerais", {"state": "MG"}),
    ("nada consta", {"state": None, "forum": None, "cell": None}),
    # work
    ("Cargo: auxiliar de limpeza", {"job_title": "auxiliar de limpeza"}),
    ("exercia a função de pedreiro, com zelo", {"job_title": "pedreiro"}),
    ("trabalhava como motorista de caminhão.", {"job_title": "motorista de caminhão"}),
    ("função: vendedor. Depois, promovido a gerente de loja.", {"job_title": "gerente de loja"}),
    ("função de reclamada na empresa", {"job_title": None}),
    ("laborava na Rua das Flores, 12, bairro Centro", {"workplace": "Rua das Flores, 12, bairro Centro"}),
    ("trabalhava em regime de escala", {"workplace": None}),
    ("Empregador: ACME Ltda, com sede", {"employer": "ACME Ltda"}),
    # ends of employment, by label
    ("pediu demissão", {"dismissal_reason": "Pedido de Demissão"}),
    ("requer a rescisão indireta", {"dismissal_reason": "Rescisão Indireta"}),
    ("por comum acordo", {"dismissal_reason": "Acordo Entre as Partes"}),
    ("fim do contrato de experiência", {"dismissal_reason": "Término de Contrato"}),
    ("dispensa imotivada", {"dismissal_reason": "Dispensa Sem Justa Causa"}),
    ("prazo comum de 15 (quinze) dias", {"deadline": "15 dias"}),
    ("8 dias para recorrer", {"deadline": "8 dias"}),
    ("", {"case_number": None, "salary": None}),
    (None, {"pis": None}),
]


@pytest.fixture(scope="module")
def extracted(spark):
    docs = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(CASES)], "doc_id int, text string")
    fields = sorted({f for _, expected in CASES for f in expected})
    return {r["doc_id"]: r.asDict() for r in rules.extract(docs, labour_br.PACK, fields=fields).collect()}


@pytest.mark.parametrize("k", range(len(CASES)), ids=[str(text)[:40] for text, _ in CASES])
def test_labour_pack(extracted, k):
    row, expected = extracted[k], CASES[k][1]
    assert {f: row[f] for f in expected} == expected
    assert all((row[f] is None) == (row[f"{f}_rule"] is None) for f in expected)


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("TERMO DE AUDIÊNCIA", "Ata de Audiência"), ("Instalada a audiência, apregoadas as partes", "Ata de Audiência"), ("Acórdão. Relator: Fulano", "Acórdão"), ("relatados e discutidos, acordam os magistrados", "Acórdão"), ("o acórdão", "Outros"),
        ("SENTENÇA\nante o exposto", "Sentença"), ("julgo improcedentes os pedidos. Isto posto", "Sentença"), ("Indefiro a tutela", "Decisão Interlocutória"), ("Notificação. Fica V. Sa. no prazo de 5 dias", "Notificação"), ("intimação", "Outros"),
        ("CONTESTAÇÃO da ré", "Manifestação"), ("apresenta impugnação", "Manifestação"), ("Excelentíssimo Senhor Juiz, dos fatos", "Petição Inicial"), ("Reclamação Trabalhista\nReclamante: Ana", "Petição Inicial"), ("reclamante", "Outros"), ("nota", "Outros"),
    ],
)
def test_document_types(spark, text, kind):
    assert value(spark, classify.document_type(F.lit(text))["type"]) == kind


def test_sections_begin_with_headings(spark):
    text = "capa\nEXMO. SR. JUIZ\nx\nS E N T E N Ç A\nVistos, etc.\nDESPACHO\nTermo de Audiência\nAcórdão\nPROCESSO nº 12\nprocesso de execução\nFica intimada a ré\nContestação\nnada"
    assert [r["kind"] for r in value(spark, structure.section_breaks(F.lit(text)))] == ["peticao_inicial", "sentenca", "decisao", "decisao", "ata_audiencia", "acordao", "novo_processo", "notificacao", "manifestacao"]


def test_a_known_client_comes_first(spark):
    text = F.lit("RÉU: ACME Ltda\nRÉU: Banco Norte\nRÉU: Ana Reis")
    known = F.array(F.lit("BANCO NORTE"))
    assert value(spark, labour_br.party("defendant", known)(text)) == "Banco Norte" and value(spark, labour_br.party("defendant")(text)) == "ACME Ltda"


def test_parties_lawyers_and_contacts(spark):
    from caseflow.packs.labour_br import defendant_kinds, defendants

    text = "RECLAMANTE: Ana Maria da Silva\nADVOGADO: Rui Costa - OAB\nTelefone (83) 99999-1234\nRECLAMADA: ACME Comércio Ltda - CNPJ 1\nRECLAMADO: Acme Comercio LTDA.\nRECLAMADO: João Souza, brasileiro\nRÉU: PARTES\n"
    assert value(spark, defendants(F.lit(text))) == ["ACME Comércio Ltda", "João Souza"]
    assert [tuple(r) for r in value(spark, defendant_kinds(F.lit(text)))] == [("ACME Comércio Ltda", "juridica"), ("João Souza", None)]
    appeal = "RECORRENTE: Empresa X\nADVOGADO: Doutora Y\nRECORRIDO: Ana\nADVOGADA: Doutor Z\n"
    assert value(spark, labour_br.lawyer("plaintiff")(F.lit(appeal))) == "Doutora Y"
    assert value(spark, labour_br.lawyer("defendant")(F.lit(appeal))) == "Doutor Z"
    phone = labour_br.contact(r"\(?\d{2}\)?\s?9?\d{4}[-\s]?\d{4}")
    assert value(spark, phone(F.lit("RECLAMANTE: Ana" + "\n" * 3 + "x" * 250 + "\nfone 83 99999-1234"))) == "83 99999-1234"
    assert value(spark, phone(F.lit("advogado: fone 83 99999-1234"))) is None


def test_similar_names_lose_no_pair(spark):
    import itertools
    import random

    rng = random.Random(3)
    words = "banco brasil unidade norte sul comercio ltda companhia grupo acucar".split()
    entries = sorted({" ".join(rng.sample(words, rng.randint(1, 5))) for _ in range(60)}) + [f"Banco Brasil Unidade Norte{k:02d}" for k in range(20)]
    broken = lambda x: "".join(c for i, c in enumerate(x) if i % 7 != 3 or c == " ")
    names = sorted({"Brasil Banco", "Bnco Brsil Unidde Nrte99", "", "a", *(broken(e) for e in entries[:40]), *(" ".join(reversed(e.split())) for e in entries[:40])})
    catalogue = spark.createDataFrame([(e, e, k) for k, e in enumerate(entries)], "name string, label string, ordinal int")
    asked = spark.createDataFrame([(n,) for n in names], "name string")
    for threshold in (0.85, 0.7):
        pairs = spark.createDataFrame(list(itertools.product(names, entries)), "name string, entry string").withColumn("score", T.token_set_ratio("name", "entry"))
        want = {(r["name"], r["entry"]): r["score"] for r in pairs.where(F.col("score") >= threshold).collect()}
        got = {(r["name"], r["entry"]): r["score"] for r in match.scored_candidates(asked, catalogue, threshold).collect()}
        assert got == want and len(want) > 100
    found = {r["name"]: r["how"] for r in match.resolve_entity(asked, catalogue).collect()}
    assert found["Brasil Banco"] == "similar"


def test_catalogues_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(match, "BROADCAST_ROWS", 3)
    four = spark.range(4).selectExpr("cast(id AS string) AS name", "id AS priority")
    with pytest.raises(ValueError):
        match.primary_secondary(spark.createDataFrame([(1, "x", 1)], "k int, name string, ordinal int"), four, ["k"])


def test_claims_fall_to_the_next_free_type(spark):
    claims = spark.createDataFrame([(1, 1, "horas extras e multa"), (1, 2, "multa do artigo 477"), (2, 1, "indenizacao por danos morais"), (3, 1, "nada")], "doc_id int, ordinal int, claim string")
    keywords = spark.createDataFrame([("extras", "horas extras", "pay", 5, 1), ("multa", "multa", "fine", 2, 2)], "keyword string, term string, category string, priority int, ordinal int")
    types = spark.createDataFrame([("A", "Horas extras com multa", 1), ("B", "Multa qualquer", 2), ("C", "Danos morais", 3)], "value string, text string, ordinal int")
    chosen, omitted = match.map_claims(claims, keywords, types)
    assert sorted((r["doc_id"], r["value"], r["category"], r["score"], r["rank"]) for r in chosen.collect()) == [(1, "A", "pay", 100, 1), (1, "B", "fine", 40, 2), (2, "C", "fuzzy", 100, 1)]
    assert omitted.count() == 0 and match.map_claims(claims, keywords, types, most=1)[1].count() == 1


def test_claims(spark):
    text = "DOS PEDIDOS: a) pagamento de horas extras com adicional; b) multa do artigo 477 da lei; c) curto. Termos em que pede"
    assert value(spark, labour_br.claims(F.lit(text)))[:2] == ["pagamento de horas extras com adicional", "multa do artigo 477 da lei"]


def test_rule_priority_and_own_rules(spark):
    from caseflow.operators import hooks

    docs = spark.createDataFrame([(1, "x=1 y=2")], "doc_id int, text string")
    a, b = rules.Rule("n", r"x=(\d)"), rules.Rule("n", r"y=(\d)")
    assert rules.extract(docs, rules.RulePack("t", (a, b))).first()["n"] == "1"
    assert rules.extract(docs, rules.RulePack("t", (b, a))).first()["n"] == "2"
    own = hooks.with_custom(rules.RulePack("t", (a,)), {"n": lambda c: F.upper(F.left(c, F.lit(1)))})
    assert rules.extract(docs, own).first()["n"] == "X"


def test_batch_outcomes(spark):
    rows = [(1, "completed")] * 3 + [(2, "completed"), (2, "completed"), (2, "error")] + [(3, "error")] * 3 + [(4, "ready")]
    found = {r["batch_id"]: (r["extraction"], r["run"]) for r in worklog.batch_outcome(worklog.item_status_matrix(spark.createDataFrame(rows, "batch_id int, status string"))).collect()}
    assert found == {1: ("ready", "completed"), 2: ("partial_ready", "partial_completed"), 3: ("error", "partial_completed"), 4: ("ready", "running")}


def test_best_evidence_keeps_the_first_of_equals(spark):
    rows = [(1, "a", "ocr", 1, 10), (1, "a", "ocr", 2, 11)]
    schema = "case_id int, doc_type string, source string, arrival int, page_number int"
    assert worklog.best_evidence(spark.createDataFrame(rows, schema)).first()["page_number"] == 10
    assert worklog.best_evidence(spark.createDataFrame([*rows, (1, "a", "bookmark", 3, 12)], schema)).first()["page_number"] == 12


def test_dates(spark):
    from datetime import date

    rows = [(date(2023, 5, 10), date(2020, 2, 1), date(2024, 1, 1)), (date(2020, 1, 1), date(2024, 1, 1), date(2024, 1, 1)), (date(2099, 1, 1), None, None)]
    out = quality.labour_dates(spark.createDataFrame(rows, "h date, d date, f date"), "h", "d", "f", F.lit("2025-01-01").cast("date")).collect()
    assert [(r["h"], r["d"], r["dates_swapped"]) for r in out] == [(date(2020, 2, 1), date(2023, 5, 10), True), (date(2020, 1, 1), None, False), (None, None, False)]


def test_enrichment_sees_only_blank_rows_and_fills_only_blanks(spark):
    from caseflow.operators import hooks

    rows = spark.createDataFrame([(1, None, "b"), (2, "a", None), (3, "a", "b")], "doc_id int, x string, y string")
    context = spark.createDataFrame([(1, "c1"), (2, "c2"), (3, "c3")], "doc_id int, body string")
    out = hooks.enrich_blank(rows, context, ["x"], ["x", "y"], lambda b: b.assign(x=b["body"], y="never"))
    assert sorted(map(tuple, out.collect())) == [(1, "c1", "b"), (2, "a", None), (3, "a", "b")]


def test_enrichment_reads_the_planned_pages_of_blank_fields(spark):
    from caseflow.operators import hooks

    rows = spark.createDataFrame([(1, None, "b"), (2, "a", None), (3, None, None), (4, "a", "b")], "doc_id int, x string, y string")
    pages = spark.createDataFrame([(d, p, f"d{d}p{p}") for d in range(1, 5) for p in range(1, 4)], "doc_id int, page_no int, text string")
    plan = spark.createDataFrame([(d, k, p) for d in (1, 2, 4) for k, p in (("form", [2, 1]), ("card", [3]))], "doc_id int, kind string, pages array<int>")
    work = lambda b: b.assign(x=b["text"].str.replace("\n", "+"), y=b["text"].str.replace("\n", "+"))
    out = hooks.enrich_from_pages(rows, pages, plan, {"x": "form", "y": "card"}, ["x", "y"], work)
    assert sorted(map(tuple, out.collect())) == [(1, "d1p2+d1p1", "b"), (2, "a", "d2p3"), (3, None, None), (4, "a", "b")]


def test_lcs_scorer(spark):
    from caseflow.operators import hooks

    assert hooks.lcs_ratio(spark.createDataFrame([("abcd", "abxd"), ("", None)], "a string, b string")).select("lcs").collect() == [(0.75,), (1.0,)]
