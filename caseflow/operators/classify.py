"""Document types, fields by type, and keyword ladders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import text as T
from caseflow.functions.grammar import either
from caseflow.operators.match import small


@dataclass(frozen=True)
class DocumentClass:
    """A type given when at least ``least`` patterns are found in the first ``head`` characters."""

    name: str
    patterns: tuple[str, ...]
    head: int
    least: int
    confidence: float


@dataclass(frozen=True)
class Kind:
    """A kind of court document: how it is headed, and what it does, by whom and in which set words. One list is one sign."""

    name: str
    #: The key of a section that begins with such a heading.
    key: str
    titles: tuple[str, ...]
    acts: tuple[str, ...] = ()
    actors: tuple[str, ...] = ()
    formulas: tuple[str, ...] = ()
    #: Further signs, each of its own.
    more: tuple[tuple[str, ...], ...] = ()

    def signs(self) -> tuple[str, ...]:
        return tuple(either(*words) for words in (self.titles, self.acts, self.actors, self.formulas, *self.more) if words)


HEARING_RECORD = Kind(
    "Ata de Audiência", "ata_audiencia", ("ata da audiência", "ata de audiência", "termo de audiência", "ata da sessão"), ("instalada a audiência", "aberta a audiência", "aberta a sessão", "apregoadas as partes", "abertos os trabalhos"),
    formulas=("audiência realizada", "realizou-se (a) audiência", "realizada a audiência", "audiência foi realizada"),
)
RULING = Kind("Acórdão", "acordao", ("acórdão", "a c ó r d ã o"), ("acordam os", "acordam , por unanimidade", "negar provimento", "dar provimento"), ("relator", "relatora", "desembargador", "desembargadora", "turma do tribunal", "tribunal regional", "tribunal superior", "tribunal de justiça"), ("relatados e discutidos", "vistos e relatados", "vistos, relatados", "é como voto"))
SENTENCE = Kind("Sentença", "sentenca", ("sentença",), ("julgo procedente", "julgo improcedente", "julgo procedentes", "julgo improcedentes", "julgo parcialmente", "julgo os pedidos"), formulas=("diante do exposto", "ante o exposto", "pelo exposto", "isto posto", "posto isso"), more=(("dispositivo", "fundamentação", "é o relatório"),))
ORDER = Kind("Decisão Interlocutória", "decisao", ("decisão interlocutória", "decisão liminar"), ("defiro o", "defiro a", "indefiro", "concedo a tutela"), formulas=("julgo extinto", "julgo extinta"), more=(("determino a intimação", "determino a citação", "determino a expedição"),))
NOTICE = Kind("Notificação", "notificacao", ("notificação", "notificação inicial"), ("fica intimad@", "fica notificad@", "fica citad@", "fica a parte", "fica v.s.a.", "fica vossa"), formulas=("prazo de", "no prazo legal"), more=(("intimação", "mandado de citação"), ("tomar ciência", "cientificad@", "para ciência")))
REPLY = Kind("Manifestação", "manifestacao", ("contestação", "contrarrazões", "réplica"), formulas=("em sua defesa", "apresentar defesa", "defesa prévia", "defesa escrita"), more=(("impugnação",), ("em resposta à", "resposta à inicial", "resposta à petição")))
CLAIM = Kind(
    "Petição Inicial", "peticao_inicial", ("petição inicial", "exordial"), ("requer a citação", "requer a notificação", "vem propor", "vem ajuizar"), ("excelentíssim@ senhor", "exm@. sr.", "vossa excelência", "v.s.a."), ("dos fatos", "da causa de pedir", "do direito", "dos pedidos"),
    (
        tuple(f"{act} {of}" for act, ofs in (("reclamação", ("trabalhista",)), ("ação", ("trabalhista", "de cobrança", "de indenização", "de despejo")), ("execução", ("fiscal", "de título"))) for of in ofs),
        tuple(f"{role}{colon}" for role in ("reclamante", "autor", "autora", "exequente") for colon in (":", " :")),
        tuple(f"{role}{colon}" for role in ("reclamad@", "réu", "ré", "executad@") for colon in (":", " :")),
        ("ministério público", "denúncia"), ("acusad@",),
    ),
)
KINDS = (HEARING_RECORD, RULING, SENTENCE, ORDER, NOTICE, REPLY, CLAIM)
#: For each kind, in order of precedence, the characters looked at, the signs needed, and the confidence.
PRECEDENCE = ((HEARING_RECORD, 1000, 1, 0.95), (RULING, 2000, 2, 0.9), (SENTENCE, 2000, 2, 0.9), (ORDER, 2000, 1, 0.85), (NOTICE, 1500, 2, 0.85), (REPLY, 1500, 1, 0.8), (CLAIM, 2000, 2, 0.75))
LABOUR_CLASSES = tuple(DocumentClass(kind.name, kind.signs(), head, least, confidence) for kind, head, least, confidence in PRECEDENCE)


def hits(text: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns are found."""
    return sum((text.rlike(f"(?u){p}").cast("int") for p in patterns), F.lit(0))


def document_type(text, classes=LABOUR_CLASSES, other: str = "Outros") -> Column:
    """struct(type, confidence); no text is other with 0, nothing found other with 0.5."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    low = F.lower(t)
    row = lambda name, c: F.struct(F.lit(name).alias("type"), F.lit(c).alias("confidence"))
    out = F.when(t == "", row(other, 0.0))
    for c in classes:
        out = out.when(hits(F.left(low, F.lit(c.head)), c.patterns) >= c.least, row(c.name, c.confidence))
    return out.otherwise(row(other, 0.5))


def mask_fields(df: DataFrame, mask: DataFrame, fields: list[str], type_column: str = "type") -> DataFrame:
    """Fields that aren't listed for the row's type become null; types without a list keep all."""
    listed = small(mask.groupBy("type").agg(F.collect_set("field").alias("__f")))
    met = df.join(listed.withColumnRenamed("type", "__type"), F.col(type_column) == F.col("__type"), "left")
    return met.withColumns({f: F.when(F.col("__f").isNull() | F.array_contains("__f", f), F.col(f)) for f in fields}).drop("__f", "__type")


def keyword_ladders(df: DataFrame, text: str, ladders: dict[str, tuple[list[tuple[str, str]], str | None]]) -> DataFrame:
    """One column per ladder of (pattern, label) and default."""
    return df.withColumns({name: T.first_match(text, rules, default) for name, (rules, default) in ladders.items()})


#: Ladders for electronic system, area of law and origin.
LABOUR_LADDERS = {
    "system": ([(r"\bpje\b|processo judicial eletronico", "PJE"), (r"\be-?proc\b", "EPROC"), (r"\be-?saj\b", "ESAJ"), (r"projudi", "PROJUDI")], "PJE"),
    "area": ([(r"vara do trabalho|trabalhista|reclamante", "Trabalhista"), (r"execucao fiscal|tributari", "Tributário"), (r"criminal|denuncia|acusad", "Criminal"), (r"consumidor", "Consumidor"), (r"\bcivel\b|indenizacao", "Cível")], "Trabalhista"),
    "proceeding": ([(r"\batord\b|rito ordinario", "Rito Ordinário"), (r"\batsum\b|sumarissimo", "Rito Sumaríssimo"), (r"\bacp\b|acao civil publica", "Ação Civil Pública"), (r"consignacao em pagamento", "Consignação em Pagamento"), (r"carta precatoria", "Carta Precatória")], None),
}


def prune_options(options: DataFrame, context: str, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """Options whose text matches a rule's second pattern go where the context column matches its first."""
    keep = F.lit(True)
    for where, gone in rules:
        keep = keep & ~(T.fold(context, "lower").rlike(where) & T.fold("text", "lower").rlike(gone))
    return options.where(keep)
