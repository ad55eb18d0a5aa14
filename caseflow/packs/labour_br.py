"""Rules for Brazilian labour cases. The pack is data: patterns, vetoes and labels in their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow.functions import text as T
from caseflow.functions.grammar import cell, either, labelled, phrase, within
from caseflow.operators import rules as R
from caseflow.operators.match import distinct_names
from caseflow.operators.rules import Rule, RulePack, register

I = "(?iu)"  # noqa: E741  either case, also of accented letters
DATE = r"(\d{2}[/.\-]\d{2}[/.\-]\d{4})"
MONEY = r"((?:\d{1,3}(?:\.\d{3})+|\d+),\d{1,2})"
WRITTEN = rf"\d{{1,2}}[ºoa]?\s+de\s+{T.MONTH}\.?\s+(?:de\s+)?\d\s*\d{{3}}"


# Forms use their argument once, and give blank or null for what they don't accept (``Rule.plain``).


def date_form(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(F.trim(c), r"[.\-]", "/"), T.DATE_FORMAT, 0)


def salary_form(c: Column) -> Column:
    """``R$ `` before the amount; one decimal is repaired."""
    return F.concat(F.lit("R$ "), F.regexp_replace(F.regexp_replace(c, r"\s", ""), r",(\d)$", ",$10"))


def pis_form(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(T.digits(c), r"^(\d{3})(\d{5})(\d{2})(\d)$", "$1.$2.$3-$4"), r"^[\d.]{12}-\d$", 0)


def _dates(field: str, patterns, **more) -> tuple[Rule, ...]:
    return tuple(Rule(field, I + p, 1, "clean", form=date_form, plain=True, **more) for p in patterns)


# ---- what announces a value, by field, in order of priority

#: A statement keeps its parts within so many characters of a line.
REACH = 100


# what brings a case to court: as a verb with its day, as a noun of which the day is told
COMING = (("distribuíd@", "distribuição"), ("protocolad@", "protocolo"), ("autuad@", "autuação"), ("ajuizad@", "ajuizamento"), ("recebid@", "recebimento"), ("proposta", "propositura"))
FILED, FILINGS = either(*(verb for verb, _ in COMING)), either(*(noun for _, noun in COMING))
SIGN = r"\s*[:\-]?\s*"
FILING = (
    either("data") + rf"\s+(?:d[aeo]\s+)?{FILINGS}{SIGN}" + DATE,
    rf"(?:{FILED}|{FILINGS})\s+(?:" + either("em", "no dia", "aos", "na data de") + rf"){SIGN}" + DATE,
    FILINGS + r"\s*:\s*" + DATE,
)
AMOUNT = r"(?:R\s*\$)?\s*((?:\d{1,3}(?:\.\d{3})+|\d+)(?:,\d{2})?)"
VALUE = (
    phrase("valor") + r"\s+(?:" + either("dado", "atribuído") + r"\s+)?(?:[àa]|d[ae])\s+" + either("causa", "ação") + SIGN + AMOUNT,
    either("atribui-se à causa o valor de", "dá-se à causa o valor de", "atribui à causa o valor de", "dá à causa o valor de") + r"\s*" + AMOUNT,
    r"(?<!\w)" + phrase("valor") + r"\s*[:\-]\s*" + AMOUNT,
)

# a hearing: an event, perhaps that it is fixed or of what kind it is, a day, an hour; the surer a statement, the earlier
DAY, HOUR = r"(\d{2}[/.\-]\d{2}[/.\-]\d{4})", r"(\d{1,2}\s?[:hH]\s?\d{2})"
EVENT = either("audiência", "audiências", "sessão de julgamento", "sessão de conciliação", "sessão de instrução")
FIXED = either(*(f"{verb}{end}" for verb in ("designad", "redesignad", "marcad", "agendad", "aprazad", "incluíd") for end in ("a", "o")), "a realizar-se", "a ser realizada", "será realizada", "realizar-se-á", "ocorrerá", "pauta")
KIND = either("inicial", "una", "primeira", "conciliação", "instrução", "julgamento", "encerramento", "telepresencial", "presencial")
CALLED = either("comparecer", "compareça", "compareçam", "comparecimento", "presença")
#: Between day and hour: a comma, dash or "às", and what else is short and holds no other number.
JOINT = r"[^\d\n]{0,20}?"
WHEN = DAY + JOINT + HOUR
HEARING = (
    EVENT + within(REACH) + FIXED + within(REACH) + WHEN,
    FIXED + within(REACH) + EVENT + within(REACH) + WHEN,
    CALLED + within(REACH) + EVENT + within(REACH) + WHEN,
    CALLED + within(REACH) + WHEN + within(REACH) + EVENT,
    EVENT + within(REACH) + KIND + within(REACH) + WHEN,
    KIND + within(REACH) + EVENT + within(REACH) + WHEN,
)
HEARING_LAST = EVENT + within(REACH) + WHEN
#: A hearing that is over, or called off, isn't the one that is looked for.
HEARING_VETO = ("realizad", "encerrad", "cancelad", "adiad", "nascimento", "nascid")

# employment: verbs of beginning and end, who did it, and when
HIRED, DISMISSED = either("admitid@", "contratad@"), either("demitid@", "dispensad@", "desligad@")
BY = r"(?:\s+" + either("pel@", "n@", "com", "para") + r"(?:\s+[\wÀ-ú]+){1,3}?)?,?"
ON = r"\s+(?:" + either("em", "no dia", "na data de", "a partir de", "desde") + r"\s+)?"
SPAN = either("a", "até", "à")
WORKED = either("trabalhou", "laborou", "prestou serviços")
HIRED_TABLE = (*(labelled(x, DATE, r"\s*[:\s]\s*") for x in ("data de admissão", "admissão", "início do contrato")), cell("admissão", DATE))
HIRED_STORY = (
    HIRED + BY + ON + DATE,
    HIRED + within(20) + phrase("a partir de") + r"\s+" + DATE,
    either("iniciou suas atividades", "iniciou sua atividade", "iniciou o trabalho", "começou a trabalhar") + within(50) + DATE,
    phrase("vínculo") + within(30) + phrase("desde") + r"\s+" + DATE,
)
HIRED_WRITTEN = tuple(verb + ON + f"({WRITTEN})" for verb in (HIRED, either("iniciou suas atividades", "iniciou a trabalhar", "começou a trabalhar")))
PERIOD = r"\s*[:\s]\s*(?:" + phrase("de") + r"\s+)?"
PAST = DATE.replace("(", "(?:", 1)
HIRED_PERIOD = (phrase("período") + PERIOD + DATE + rf"\s+{SPAN}\s+{PAST}", WORKED + within(30) + phrase("de") + r"\s+" + DATE + rf"\s+{SPAN}\s")
LEFT_TABLE = (*(labelled(x, DATE, r"\s*[:\s]\s*") for k in ("demissão", "dispensa", "afastamento", "desligamento") for x in (f"data (da) (de) (do) {k}", k)), cell("demissão", DATE))
LEFT_STORY = (DISMISSED + r"(?:\s+" + phrase("sem justa causa") + ")?,?" + ON + DATE, either("rescisão", "término", "encerramento") + r"\s+" + phrase("(do) contrat…") + within(30) + DATE)
LEFT_WRITTEN = (DISMISSED + ON + f"({WRITTEN})",)
LEFT_PERIOD = (phrase("período") + PERIOD + PAST + rf"\s+{SPAN}\s+" + DATE, WORKED + within(30) + phrase("de") + r"\s+" + PAST + rf"\s+{SPAN}\s+" + DATE)
#: Words by which a date or an amount is another one.
DATE_VETO = ("nascimento", "ctps", "carteira", "identidade", "rg", "cpf", "expedi")
LEFT_VETO = (*DATE_VETO, "distribui", "autua", "audi[êe]ncia", "assinatura", "publica")
#: An amount that is claimed, set by others, or decided is none that is paid.
NOT_PAID = {
    "claimed": ("deveria", "devid[oa]s?", "pleite", "postul", "diferen[çc]a"),
    "set by others": ("piso", "m[íi]nimo", "normativ", "base de c[áa]lculo", "categoria"),
    "decided": ("multa", "indeniza", "honor[áa]rio", "custas", "dano", "condena", "valor da causa"),
}
SALARY_VETO = tuple(word for family in NOT_PAID.values() for word in family)

# pay: forms name it, stories tell who got it, the rest is looked at with care
REAIS = r"R\$\s*" + MONEY
PAY = either("salário", "salários", "remuneração", "ordenado", "vencimento", "vencimentos", "proventos")
#: Which pay: with a hyphen or without; and how the amount follows.
WHICH = r"(?:[\s\-]+" + either("base", "contratual", "mensal", "fixo", "fixa", "bruto", "bruta", "total", "atual", "vigente", "básico", "médio") + ")*"
IS = SIGN + r"(?:" + either("é de", "era de", "foi de", "de", "no valor de", "na quantia de", "no importe de", "na importância de", "à razão de", "no montante de", "equivalente a", "correspondente a") + r"\s*)?"
#: Verbs of getting, by stem and endings.
GETS = (("perceb", ("ia", "eu", "endo", "e")), ("receb", ("ia", "eu", "endo", "e")), ("ganh", ("ava", "ou", "ando", "a")), ("aufer", ("ia", "iu", "indo", "e")))
GOT = "(?:" + "|".join(stem + f"(?:{'|'.join(ends)})" for stem, ends in GETS) + ")"
PAID_BY = either("holerite", "contracheque", "recibo de pagamento", "folha de pagamento")
# a form's line and a table's cell say what they hold; so does who got it; the rest is looked at with care
SALARY_FORM = (r"(?m)^\s*(?:\d+\s*[.)]?\s*)?" + PAY + WHICH + r"\s*[:\-]?\s*" + REAIS, PAY + WHICH + r"\s*:\s*" + REAIS, cell("(último) salário (base) (mensal)", REAIS), cell("(última) remuneração (mensal)", REAIS))
SALARY_PAID = (rf"\b{GOT}\b" + within(REACH) + REAIS, HIRED + within(REACH) + PAY + WHICH + IS + REAIS)
SALARY_ANY = (PAY + WHICH + IS + REAIS, PAID_BY + within(REACH) + REAIS, REAIS + r"\s+" + either("por mês", "ao mês", "mensal", "mensais"), PAY + WHICH + within(30) + REAIS, either("média salarial", "média remuneratória") + IS + REAIS)
PAYSLIP = tuple(labelled(x, r"(?:R\$\s*)?" + MONEY, r"\s*[:\s]\s*") for x in ("salário base", "salário contratual", "total (de) vencimentos", "total (de) proventos", "salário mensal"))

# documents: names of the register, then how its number is announced
ELEVEN = r"(?<!\d)(\d(?:[.\s\-]*\d){10})(?!\d)"
NO = r"(?:\s*n[º°o.]?\s*)?"
REGISTERS = (r"PIS\s*[/\-–\s]\s*PASEP", r"PASEP\s*[/\-–\s]\s*PIS", r"(?:PIS|NIT)\s*/\s*(?:PASEP\s*/\s*)?(?:NIT|PIS)", "NIT", "NIS", "PIS", r"P\s*I\s*S", "PASEP")
PIS = (
    *(rf"(?:inscri|cadastr|portador)\w*\s+(?:no|do|ao|junto\s+ao)\s+{r}\s*(?:sob\s+)?(?:o\s+)?(?:n[úu]mero\s+)?{NO}{ELEVEN}" for r in REGISTERS[:1] + REGISTERS[5:6]),
    *(rf"(?:^|[\s:,;(\d])(?:n[º°.]?\s*)?{r}{NO}\s*[:\-]?\s*{ELEVEN}" for r in REGISTERS),
)
CARD, SERIES = either("CTPS", "carteira de trabalho", "carteira profissional"), phrase("série") + NO
NUMBERED = CARD + NO + r"\s*:?\s*"
CTPS = (
    NUMBERED + r"(\d{4,8}\s*[-/]\s*\d{2,5}\s*[-/]?\s*[A-Z]{2})\b",
    NUMBERED + rf"(\d{{4,8}}\s*,?\s*{SERIES}\s*\d{{2,5}}(?:\s*[-/]\s*[A-Z]{{2}})?)",
    NUMBERED + r"(\d{4,8}\s*[-/]\s*\d{2,5})\b",
    NUMBERED + r"(\d{4,8})\b",
)
#: Fixed value: a digital card's number is the holder's CPF.
CTPS_DIGITAL = either("CTPS digital", "carteira de trabalho digital") + within(60) + r"(\d{3}\.\d{3}\.\d{3}-\d{2})"
UNIT = either("dias", "dia", "meses", "mês")
DEADLINE = (
    phrase("prazo (legal) (comum) (sucessivo) (de)") + rf"\s*(\d{{1,3}})\s*(?:\([^)]*\)\s*)?({UNIT})",
    rf"(\d{{1,3}})\s*(?:\([^)]*\)\s*)?({UNIT})\s+" + phrase("para") + r"\s+" + either("contestar", "manifestar", "se manifestar", "responder", "recorrer"),
)

# ends of employment: an act of ending, and in what manner; who ends it, or what does
ENDS = either("dispensa", "dispensad@", "demissão", "demitid@", "despedida", "despedid@", "despedimento", "desligamento", "desligad@")
NO_CAUSE = either("sem (qualquer) (justa) causa", "sem justo motivo", "sem motivo", "imotivada", "imotivado", "imotivadamente", "injusta", "injustamente", "arbitrária")
CAUSE = rf"(?<!sem\s)(?<!inexistente\s){either('justa causa', 'falta grave')}"
ASKED = either(*(f"{verb} {what}" for verb in ("pediu", "pedido de", "requereu", "solicitou") for what in ("(a) (sua) demissão", "(o) (seu) desligamento", "(as) contas", "para sair")), "demitiu-se")
RUN_OUT = either("término", "fim", "encerramento", "termo final", "extinção") + r"\s+(?:d[eo]\s+)?" + either("contrato", "prazo", "experiência")
AGREED = either("comum acordo", "acordo mútuo", "mútuo acordo", "acordo entre as partes", "distrato")
BY_FIRM = ENDS + r"\s+" + either("pelo", "pela") + r"\s+" + either("empregador", "empregadora", "empresa", "reclamada", "ré")
#: The labels, in their order of precedence. What is said for each stands above.
DISMISSAL = (
    (phrase("rescisão indireta"), "Rescisão Indireta"),
    (phrase("rescisão contratual"), "Rescisão Contratual"),
    (ENDS + r",?\s+" + NO_CAUSE + "|" + BY_FIRM, "Dispensa Sem Justa Causa"),
    (CAUSE + r"(?!\s+(?:na|para))", "Dispensa Com Justa Causa"),
    (ASKED, "Pedido de Demissão"),
    (RUN_OUT, "Término de Contrato"),
    (AGREED, "Acordo Entre as Partes"),
    (phrase("dispensad@") + r"(?!\s+com)", "Dispensa Sem Justa Causa"),
)

# parties: what one is called who asks, and who is asked; most are two endings of one verb
VERBS = ("RECLAM", "IMPETR", "AGRAV", "EMBARG", "CONSIGN", "DEMAND", "DENUNCI", "REPRESENT", "NOTIFIC", "INTERPEL", "SUPLIC", "ARREMAT", "LIQUID", "DEPREC")
ASKS = (*(f"{v}ANTE" for v in VERBS), "RECORRENTE", "REQUERENTE", "EXEQUENTE", "APELANTE", "EXCIPIENTE", "SUSCITANTE", "QUERELANTE", "OPOENTE", "AUTOR", "AUTORA", "CREDOR", "CREDORA")
ASKED_OF = (*(f"{v}AD[OA]" for v in VERBS), "RECORRID[OA]", "REQUERID[OA]", "EXECUTAD[OA]", "APELAD[OA]", "EXCEPT[OA]", "SUSCITAD[OA]", "QUERELAD[OA]", "OPOST[OA]", "R[ÉE]U?", "DEVEDORA?")
#: Misspelt labels that texts hold.
MISSPELT = ("IMPETTRADO", "CONSIGNADOV")
PARTY = {"plaintiff": f"(?:{'|'.join(ASKS)})", "defendant": f"(?:{'|'.join((*ASKED_OF, *MISSPELT))})"}
NAME_END = r"(?:,|;|\n|\s+-\s+|\s+CPF|\s+CNPJ|\s+RG|\s+ADVOGAD|\s+RECLAMAD|\s+RECLAMANTE|$)"
TITLE = r"([^,.;\n]{3,60})"
ROLE = either("função", "cargo", "ocupação", "atividade")
#: How somebody comes to be called by a job, in two tenses where it has them.
WORKS = either(*(f"{verb} {how}" for verb in ("trabalhava", "trabalhou", "laborava", "laborou", "atuava", "atuou", "serviu") for how in ("como", "na função de", "no cargo de")))
RISES = either(*(f"{verb} {to}" for verb in ("promovid@", "elevad@", "transferid@", "reenquadrad@") for to in ("ao cargo de", "à função de", "para o cargo de", "para", "ao", "à", "a")))
TITLE_LINE = r"([^,.;|\n]{3,60}?)(?=\s*(?:[,.;|\n]|\s(?:" + either("matrícula", "matr", "setor", "admissão", "salário", "CBO", "data") + r")\b|$))"
JOB = (
    # forms: a number of the field, the label or both labels, dots or a colon, the title up to the next field
    r"(?m)^\s*(?:\d{1,2}\s*[.)\-]?\s*)?" + ROLE + r"(?:\s*/\s*" + ROLE + r")?\s*(?:[:\-]|\.{2,})\s*" + TITLE_LINE,
    ROLE + r"\s*(?:[:\-]|" + phrase("de") + r"\s)\s*" + TITLE,
    r"(?:exerc(?:ia|eu|endo)|ocup(?:ava|ou|ando)|desempenh(?:ava|ou|ando))\s+(?:[ao]s?\s+)?" + ROLE + r"\s+de\s+" + TITLE,
    HIRED + r"\s+" + either("para", "na", "no", "como", "para exercer") + r"\s+(?:[ao]\s+)?(?:" + ROLE + r"\s+de\s+)?" + TITLE,
    either("na qualidade de", "na condição de") + r"\s+" + TITLE,
    WORKS + r"\s+" + TITLE,
    RISES + r"\s+" + TITLE,
    cell("cargo", r"([^|\n]{3,60})"),
    cell("função", r"([^|\n]{3,60})"),
    phrase("CBO") + r"\s*:?\s*\d{4}-?\d{2}\s*[-–:]\s*" + TITLE,
)
#: Words that are of a case or a contract, of a time or a place, or of an amount, and never of a job.
NO_JOB = {
    "case": ("reclamad", "reclamante", "justi[çc]a", "processo", "vara", "juiz", "advogad[oa] d", "testemunha", "audi[êe]ncia", "senten[çc]a"),
    "contract": ("empresa", "contrato", "ctps", "v[íi]nculo", "rescis", "dispensa", "admiss", "demiss", "f[ée]rias", "estabilidade"),
    "time and place": ("jornada", "hor[áa]rio", "per[íi]odo", "hoje", "m[êe]s", "rua", "avenida", "bairro", "cidade"),
    "amount": ("sal[áa]rio", "remunera", "r\\$", "reais", "adicional", "horas extras", "comiss[õo]es"),
}
JOB_VETO = r"(?iu)(?:^|\s)(?:" + "|".join(word for family in NO_JOB.values() for word in family) + ")"
PLACE = r"([^\n.;]{5,120})"
WORKPLACE = (
    either("local de trabalho", "local da prestação", "endereço de trabalho") + r"(?:\s+(?:dos?|de)\s+" + phrase("serviços") + r")?\s*[:\-]?\s*" + PLACE,
    either("laborava", "laborou", "trabalhava", "trabalhou", "prestava serviços", "prestou serviços", "lotad@") + r"\s+(?:na|no|em)\s+" + PLACE,
)
#: A place isn't told by a clause, by a time, or by how one works.
NO_PLACE = {"clause": ("que", "quando", "onde", "como", "sendo", "foi", "era", "ser", "estava", "tendo", "pois"), "time": ("horas?", "per[íi]odo", "jornada", "hor[áa]rio", "dias?", "turno", "escala", "data"), "manner": ("regime", "condi[çc][õo]es", "fun[çc][ãa]o", "cargo", "benef[íi]cio", "favor", "car[áa]ter")}
WORKPLACE_VETO = r"(?iu)^(?:" + "|".join(word for family in NO_PLACE.values() for word in family) + r")\b"
ADDRESS = r"(?iu)\b(rua|r\.|avenida|av\.|rodovia|rod\.|estrada|travessa|pra[çc]a|alameda|quadra|lote|km|bairro|n[º°])"
FIRM = r"([^\n,;]{3,80}?)(?=\s*(?:[,;\n]|\s-\s|CNPJ|$))"
EMPLOYER = (labelled("empregador@", FIRM, r"\s*[:\-]\s*"), labelled("empregador", FIRM, r"\s*[:\-]\s*"), labelled("(razão) (social) (da) empresa", FIRM, r"\s*:\s*"), HIRED + r"\s+" + phrase("pela empresa") + r"\s+([^\n,;.]{3,80})")
STATES = tuple("AC AL AP AM BA CE DF ES GO MA MT MS MG PA PB PR PE PI RJ RN RS RO RR SC SP SE TO".split())
CITY = r"([A-ZÀ-Ú][\wÀ-ú' ]{2,40}?)\s*[-/–]\s*([A-Z]{2})\b"
OF = r"\s+d[aeo]\s+"
DISTRICT = tuple(lead + OF + CITY for lead in (phrase("comarca"), phrase("vara do trabalho"), phrase("foro"), phrase("fórum trabalhista"), either("juízo", "jurisdição"), phrase("vara") + r"\s+\w+"))
BRANCH = either("do trabalho", "cível", "federal", "criminal", "da fazenda pública", "de família")
BENCH = (r"(\d{1,3}\s?[ªaº]\s+" + phrase("vara") + r"\s+" + BRANCH + r"(?:\s+d[aeo]\s+[^\n,;]{3,40})?)", "(" + phrase("vara única") + r"(?:\s+d[aeo]\s+[^\n,;]{3,40})?)")
FORUM = ("(" + either("fórum", "foro") + r"\s+(?:" + either("trabalhista", "regional", "central", "cível", "do trabalho") + r"|d[aeo])\s+[^\n,;]{3,60})", "(" + either("central", "secretaria") + r"\s+" + either("de audiências", "de conciliação", "da vara") + r"[^\n,;]{0,40})")
CELL = (labelled("célula", r"([^\n,;]{2,40})", r"\s*[:\-]\s*"), labelled("núcleo", r"([^\n,;]{2,40})", r"\s*[:\-]\s*"))
CONTACT_YES, CONTACT_NO = r"(?iu)reclamante|autora?\b|residente|domiciliad|qualifica", r"(?iu)advogad|oab|escrit[óo]rio|vara|tribunal|tst|trt|reclamada"
GENERIC_MAIL = r"(?iu)^(?:contato|sac|atendimento|noreply|no-reply|suporte|vara|secretaria)@"


def hearing_form(c: Column) -> Column:
    """``dd/mm/yyyy hh:mm``: whatever parts the day, and an hour with "h"."""
    day = F.regexp_replace(c, r"^(\d{2}).(\d{2}).", "$1/$2/")
    return F.regexp_replace(F.regexp_replace(day, r"(\d)\s?[:hH]\s?(\d{2})$", "$1:$2"), r"\s+(\d):", " 0$1:")


def dismissal_reason(text: Column) -> Column:

    def ladder(x: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for pattern, label in DISMISSAL:
            out = out.when(T.may_match(x["low"], I + pattern) & x["head"].rlike(I + pattern), F.lit(label))
        return out

    head = F.left(text, F.lit(5000))
    return T.bind(F.struct(head.alias("head"), T.caseless(head).alias("low")), ladder)


def salary_fallback(text: Column) -> Column:
    """The first amount of 500 to 100,000 in the first 5000 characters."""
    found = F.regexp_extract_all(F.left(text, F.lit(5000)), F.lit(r"R\$\s*" + MONEY), F.lit(1))
    value = F.try_element_at(F.filter(found, lambda v: T.money_to_decimal(v).between(500, 100000)), F.lit(1))
    return salary_form(value)


def payslip_salary(text: Column) -> Column:
    """Labelled amounts of 800 to 50,000, in order of the labels."""
    in_range = lambda v: T.money_to_decimal(v).between(800, 50000)
    return F.coalesce(*(Rule("salary", I + p, 1, accept=lambda v: in_range(v)).value(text) for p in PAYSLIP))


def job_title(text: Column) -> Column:
    """All hits of all patterns, vetted; the last one."""
    clean = lambda v: F.trim(F.regexp_replace(F.regexp_replace(v, r"(?iu)\s+(?:com|para|na|no|em|desde|percebendo|recebendo|matr[íi]cula|matr|setor|cbo|data)\s.*$", ""), r"\s+", " "))
    ok = lambda v: ~v.rlike(JOB_VETO) & (F.length(v) > 3) & (F.size(F.split(v, " ")) <= 6)
    return R.last_of_all(text, [I + p for p in JOB], clean, ok)


#: The states that each regional labour court serves, by its number.
REGIONS = dict(enumerate("RJ SP MG RS BA PE CE PA PR DF AM SC PB RO SP MA ES GO AL SE RN PI MT MS".split(), 1))
STATE_NAMES = {"rio de janeiro": "RJ", "são paulo": "SP", "minas gerais": "MG", "rio grande do sul": "RS", "bahia": "BA", "pernambuco": "PE", "ceará": "CE", "paraná": "PR", "santa catarina": "SC", "paraíba": "PB", "maranhão": "MA", "espírito santo": "ES", "goiás": "GO"}


def state_ladder(text: Column) -> Column:
    """City/UF, UF beside a court's name, ``UF:``, the region named, the region of the case number, a dash, then names of states; the last two in the first 2000 characters."""
    codes, head = "|".join(STATES), F.left(text, F.lit(2000))
    take = lambda x, p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))
    region = F.create_map(*(F.lit(v) for k, uf in REGIONS.items() for v in (str(k), uf)))
    number = lambda p: F.try_element_at(region, F.regexp_replace(F.coalesce(take(text, p), F.lit("")), "^0+", ""))
    name = F.when(F.lit(False), F.lit(None).cast("string"))
    for words, uf in STATE_NAMES.items():
        name = name.when(head.rlike(rf"{I}\b{phrase(words)}\b"), F.lit(uf))
    return F.coalesce(
        take(text, rf"[A-ZÀ-Ú][\wÀ-ú]+\s*/\s*({codes})\b"),
        take(text, rf"(?u)(?:Vara|Comarca|Foro|Fórum|Tribunal)[^\n]{{0,60}}?[-–/]\s*({codes})\b"),
        take(text, rf"\b(?:UF|Estado)\s*:\s*({codes})\b"),
        number(rf"{I}(?:TRT|tribunal\s+regional\s+do\s+trabalho)[^\n]{{0,12}}?\b(\d{{1,2}})\s*[ªa]?\s*(?:regi[ãa]o|\b)"),
        number(r"\b\d{7}-\d{2}\.\d{4}\.5\.(\d{2})\.\d{4}\b"),
        take(head, rf"\s[-–]\s*({codes})\b"),
        name,
    )


def court(text: Column) -> Column:
    """struct(origin, court, instance): superior, then regional, then first instance; appeals only by the head."""
    head = F.left(text, F.lit(1500))
    row = lambda o, c, i: F.struct(F.lit(o).alias("origin"), F.lit(c).alias("court"), F.lit(i).alias("instance"))
    second = head.rlike(r"(?iu)recurso\s+ordin[áa]rio|ac[óo]rd[ãa]o|agravo|relator|turma\b|recorrente")
    return (
        F.when(head.rlike(r"(?iu)tribunal\s+regional\s+do\s+trabalho") & second, row("TRT", "Tribunal Regional do Trabalho", "Segunda Instância"))
        .when(head.rlike(r"(?iu)tribunal\s+superior\s+do\s+trabalho|\bTST\b"), row("TST", "Tribunal Superior do Trabalho", "Instância Superior"))
        .when(text.rlike(r"(?iu)vara\s+do\s+trabalho"), row("TRT", "Vara do Trabalho", "Primeira Instância"))
        .when(text.rlike(r"(?iu)minist[ée]rio\s+p[úu]blico\s+do\s+trabalho|superintend[êe]ncia\s+regional"), row("Administrativo", "Órgão administrativo", "Administrativa"))
    )


def claims(text: Column, most: int = 15) -> Column:
    """Claims in the block behind the heading, up to a closing phrase; distinct by their first 50 characters."""
    x = T.clean_text(text)
    start = r"(?isu)^.*?(?:D\s*O\s*S\s+P\s*E\s*D\s*I\s*D\s*O\s*S|DOS\s+REQUERIMENTOS|PEDIDOS\s+FINAIS|(?:diante|ante)\s+(?:do|o)\s+exposto,?\s*requer|pelo\s+exposto,?\s*requer|\bPEDIDOS\s*:|assim\s+[ée]\s+a\s+presente\s+para\s+reclamar)\s*:?\s*"
    block = F.left(F.regexp_replace(x, start, ""), F.lit(12000))
    block = F.regexp_replace(block, r"(?isu)(?:atribui-se\s+[àa]\s+causa|termos\s+em\s+que|nestes\s+termos|d[áa]-se\s+[àa]\s+causa|p\.\s*deferimento|pede\s+deferimento|tudo\s+a\s+ser\s+apurado|isto\s+posto\s+requer|protesta\s+pela\s+produ[çc][ãa]o).*$", "")
    body = lambda mark: F.slice(F.split(block, rf"(?iu)(?:^|\s){mark}", -1), 2, 10000)
    tidy = lambda parts: F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"\s+", " "), r";?\s*$", ""))), lambda p: F.length(p) > 10)
    letters, dashes, numbers = tidy(body(r"[a-z]\)")), tidy(body("[a-z]-")), tidy(body(r"\d{1,2}\)"))
    verbs = tidy(F.regexp_extract_all(block, F.lit(r"(?iu)(?:requer(?:-se)?|requeiro|sejam?|condenar|a\s+condena[çc][ãa]o)\s+[^.]{20,300}\."), F.lit(0)))
    found = F.when(F.size(letters) > 0, letters).when(F.size(dashes) > 0, dashes).when(F.size(numbers) > 0, numbers).otherwise(verbs)
    return F.when(x.rlike(start.replace("^.*?", "")), distinct_claims(found, most)).otherwise(F.array().cast("array<string>"))


def distinct_claims(found: Column, most: int = 15) -> Column:
    """First of each by the lower-case first 50 characters, at most ``most``."""
    key = lambda v: F.lower(F.left(v, F.lit(50)))
    kept = F.aggregate(found, F.array().cast("array<string>"), lambda acc, v: F.when((F.size(acc) >= most) | F.exists(acc, lambda a: key(a) == key(v)), acc).otherwise(F.concat(acc, F.array(v))))
    return F.slice(kept, 1, most)


#: What follows a name and is none of it; what is no name.
AFTER_NAME = r"(?iu)\s*(?:\([^)]*\)|\b(?:CNPJ|CPF|inscrit[oa]|pessoa\s+jur[íi]dica|com\s+sede|estabelecid[oa]|advogad|endere[çc]o|valor|data|autua|p[áa]gina)\b.*)$"
NO_NAME = r"(?iu)^(?:partes|advogad|n[ãa]o\s+informad|em\s+segredo|\d+)"


def defendants(text: Column, threshold: float = 0.85) -> Column:
    """Names behind defendant labels, cleaned, alike ones once, companies first."""
    found = F.regexp_extract_all(text, F.lit(rf"(?u)\b{PARTY['defendant']}\s*:\s*(.{{3,120}}?){NAME_END}"), F.lit(1))
    clean = F.transform(found, lambda v: T.clean_value(F.regexp_replace(F.regexp_replace(v, AFTER_NAME, ""), AFTER_NAME, "")))
    return distinct_names(F.array_distinct(F.filter(clean, lambda v: (F.length(v) > 3) & ~v.rlike(NO_NAME))), threshold)


def defendant_kinds(text: Column) -> Column:
    """array<struct<name, kind>>: each defendant and whether it is a company or a person."""
    return F.transform(defendants(text), lambda n: F.struct(n.alias("name"), T.person_type(n).alias("kind")))


def parties(text: Column, kind: str) -> Column:
    """The names behind the labels of one side, in order, without what isn't a name."""
    found = F.regexp_extract_all(text, F.lit(rf"(?u)\b{PARTY[kind]}\s*:\s*(.{{3,120}}?){NAME_END}"), F.lit(1))
    clean = F.transform(found, lambda v: T.clean_value(F.regexp_replace(v, AFTER_NAME, "")))
    return F.array_distinct(F.filter(clean, lambda v: (F.length(v) > 2) & ~v.rlike(NO_NAME)))


def party(kind: str, known: Column | None = None):
    """Of several names on a side a known client's (``known``: folded names), else a company's, else the last; the first plaintiff."""

    def make(text: Column) -> Column:
        names = parties(text, kind)
        if kind == "plaintiff":
            return F.try_element_at(names, F.lit(1))
        firm = F.filter(names, lambda n: F.coalesce(T.person_type(n) == "juridica", F.lit(False)))
        chosen = [F.filter(names, lambda n: F.array_contains(known, T.fold(n)))] if known is not None else []
        return F.coalesce(*(F.try_element_at(x, F.lit(1)) for x in (*chosen, firm)), F.try_element_at(names, F.lit(-1)))

    return make


def bar_number(text: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"(?u)OAB\s*[/:]?\s*([A-Z]{2})\s*(?:n[º°.]?\s*)?([\d.]{3,8})", 0), r"\s+", " "), F.lit(""))


#: Roles in an appeal, and the side of the first instance that they stand for.
APPEAL = {"plaintiff": r"(?:RECORRENTE|AGRAVANTE|APELANTE|EMBARGANTE)", "defendant": r"(?:RECORRID[OA]|AGRAVAD[OA]|APELAD[OA]|EMBARGAD[OA])"}


def lawyer(role: str):
    """The name behind "Advogado" within three lines below a line with the role's label; in an appeal the appeal's roles count first."""
    name = rf"(?u)ADVOGAD[OA](?:\s+D[OA]\s+\w+)?\s*:?\s*(.{{3,80}}?){NAME_END}"

    def make(text: Column) -> Column:
        found = [R.anchored_value(text, rf"(?u)\b{labels}\b", 0, 3, name, 1) for labels in (APPEAL[role], PARTY[role])]
        return T.some(T.clean_value(F.coalesce(*found)))

    return make


def contact(pattern: str, skip: str | None = None, lines: int = 15):
    """The first match whose neighbourhood speaks for the adverse party: within 200 characters, else within ``lines`` lines of its label; else the only one there is."""

    def make(text: Column) -> Column:
        near = R.guarded_first(text, pattern, CONTACT_YES, CONTACT_NO)
        window = F.coalesce(R.line_window(text, rf"(?u)\b{PARTY['plaintiff']}\b\s*:", 0, lines), F.lit(""))
        quiet = F.array_join(F.filter(F.split(window, r"\n"), lambda x: ~x.rlike(CONTACT_NO)), "\n")
        below = F.nullif(F.regexp_extract(quiet, pattern, 0), F.lit(""))
        every = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        only = F.when((F.size(every) == 1) & ~text.rlike(CONTACT_NO), every[0])
        found = F.coalesce(near, below, only)
        return F.when(~found.rlike(skip), found) if skip else found

    return make


#: Words that speak for, and against, a city being the court's.
JUDICIAL = r"(?iu)\b(vara|comarca|foro|f[óo]rum|ju[íi]zo|tribunal|justi[çc]a|ju[íi]z)\b"
PLACE_OF_LIVING = r"(?iu)\b(rua|avenida|av|residente|domiciliad[oa]|endere[çc]o|bairro|cep|sede)\b"


def city_candidates(text: Column, look_back: int = 300) -> Column:
    """array<struct<score, at, city, state>> of "City - UF", best first: court words before it less twice the address words, if more than none."""
    p = rf"(?u)([A-ZÀ-Ú][\wÀ-ú']+(?:\s(?:d[aeo]s?\s)?[A-ZÀ-Ú][\wÀ-ú']+){{0,4}})\s*[-/–]\s*({'|'.join(STATES)})\b"
    take = lambda g: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    parts = F.arrays_zip(F.split(text, p, -1).alias("gap"), take(0).alias("whole"), take(1).alias("city"), take(2).alias("state"))
    count = lambda c, words: F.size(F.regexp_extract_all(c, F.lit(words), F.lit(0)))
    start = F.from_json(F.lit('{"at":0,"tail":"","out":[]}'), "struct<at: int, tail: string, out: array<struct<score: int, at: int, city: string, state: string>>>")

    def step(acc: Column, z: Column) -> Column:
        before = F.right(F.concat(acc["tail"], z["gap"]), F.lit(look_back))
        whole, at = F.coalesce(z["whole"], F.lit("")), acc["at"] + F.length(z["gap"])
        score = count(before, JUDICIAL) - 2 * count(before, PLACE_OF_LIVING)
        found = F.struct(score.alias("score"), at.alias("at"), z["city"].alias("city"), z["state"].alias("state"))
        out = F.when(z["city"].isNotNull() & (score > 0), F.concat(acc["out"], F.array(found))).otherwise(acc["out"])
        return F.struct((at + F.length(whole)).alias("at"), F.right(F.concat(before, whole), F.lit(look_back)).alias("tail"), out.alias("out"))

    order = lambda a, b: F.when(a["score"] != b["score"], b["score"] - a["score"]).otherwise(a["at"] - b["at"])
    return F.array_sort(F.aggregate(parts, start, step, lambda acc: acc["out"]), order)


def court_city(text: Column) -> Column:
    best = F.try_element_at(city_candidates(text), F.lit(1))
    return F.when(best.isNotNull(), F.concat_ws(" - ", best["city"], best["state"]))


def procedure_type(filename: Column, text: Column) -> Column:
    """A file name's prefix beats the text's first 3000 characters; the most specific comes first."""
    by_name = T.first_match(filename, [("^atord", "ATOrd"), ("^atsum", "ATSum"), ("^acp", "ACP"), ("^cumsen", "CumSen"), ("^rot", "ROT"), ("^rorsum", "RORSum")])
    by_text = T.first_match(F.left(text, F.lit(3000)), [("rito sumarissimo", "ATSum"), ("acao civil publica", "ACP"), ("cumprimento de sentenca", "CumSen"), ("recurso ordinario", "ROT"), ("acao trabalhista|reclamacao trabalhista", "ATOrd")])
    return F.coalesce(by_name, by_text)


#: What a header calls the rite, the most specific first, and the file name's prefix for it.
RITES = (("sumarissimo", "Sumaríssimo", "atsum"), ("ordinario", "Ordinário", "atord"), ("sumario", "Sumário", None))


def rite(filename: Column, text: Column, head: int = 3000) -> Column:
    """The rite by the file name's prefix, else by the header."""
    by_name = T.first_match(filename, [(f"^{prefix}", name) for _, name, prefix in RITES if prefix])
    return F.coalesce(by_name, T.first_match(F.left(text, F.lit(head)), [(rf"\b{word}\b", name) for word, name, _ in RITES]))


def header_info(filename: Column, text: Column, head: int = 3000) -> Column:
    """E4, E5, E6 from the header: struct(district, state, unit, rite).

    The district is the city behind a court's full name, then the best of the cities with a state (O8), then what follows
    any word for a court. The state is the one written beside the city; others come from a table of cities (J7).
    """
    top = F.regexp_replace(F.left(text, F.lit(head)), r"[_\s]+", " ")
    name, tail = r"([A-ZÀ-Ú][\wÀ-ú']+(?: (?:d[aeo]s? )?[A-ZÀ-Ú][\wÀ-ú']+){0,4})", rf"(?: ?[-–/,] ?({'|'.join(STATES)})\b)?"
    full = "(?:" + "|".join(rf"(?i:{x})" for x in (either("fórum", "foro") + r"\s+" + either("trabalhista", "criminal", "cível"), phrase("vara do trabalho"), phrase("comarca"))) + r") [Dd][AEOaeo] "
    loose = rf"(?i:{either('vara', 'juízo', 'foro', 'fórum', 'tribunal', 'justiça')})[^,;.]{{0,40}}? [Dd][AEOaeo] "
    take = lambda p, g: F.nullif(F.regexp_extract(top, f"(?u){p}{name}{tail}", g), F.lit(""))

    def info(best: Column) -> Column:
        district = F.coalesce(take(full, 1), best["city"], take(loose, 1))
        state = F.when(take(full, 1).isNotNull(), F.coalesce(take(full, 2), F.when(best["city"] == take(full, 1), best["state"]))).when(best["city"].isNotNull(), best["state"]).otherwise(take(loose, 2))
        unit = F.nullif(F.regexp_extract(top, rf"{I}(\d+) ?[ªº]? ?{phrase('vara do trabalho')}", 1), F.lit(""))
        return F.struct(district.alias("district"), state.alias("state"), unit.alias("unit"), rite(filename, text, head).alias("rite"))

    none = F.struct(F.lit(None).cast("int").alias("score"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("state"))
    return T.bind(F.coalesce(F.try_element_at(city_candidates(top), F.lit(1)), none), info)


def decision_type(text: Column) -> Column:
    x = F.lower(text)
    return F.when(x.rlike(r"(?su)sentença\s+(proferida|publicada|transitada)|julgo\s+(im)?procedente|dispositivo.*sentença|sentença.*julg"), "Sentença").when(x.rlike(r"(?su)acórdão\s+(proferido|publicado)|acordam\s+os\s+desembargadores|vistos.*relatados.*e\s+discutidos"), "Acórdão")


def decision_result(text: Column) -> Column:
    """Negative before positive."""
    x, verb = F.lower(text), r"(?:(?:julgo|julguei)|(?:foi|restou|encontra-se)|(?:ação|pedido|recurso)\s+(?:foi|restou|julgad[ao]))\s+.*"
    return F.when(x.rlike(rf"(?u){verb}(?:improcedente|indeferid[ao])"), "Indeferido").when(x.rlike(rf"(?u){verb}(?:procedente|deferid[ao])"), "Deferido")


def decision_reason(text: Column) -> Column:
    """The first sentence of more than 60 characters."""
    return F.try_element_at(F.filter(F.transform(F.split(text, r"\."), F.trim), lambda p: F.length(p) > 60), F.lit(1))


HEARING_KIND = [("una", "Una"), ("instrucao", "Instrução"), ("conciliacao", "Conciliação"), ("inicial", "Inicial"), ("julgamento", "Julgamento"), ("encerramento", "Encerramento")]
LINK = r"https?://[^\s<>\"')]+"


def hearing_link(text: Column) -> Column:
    """A link of a meeting platform near "audiência" first, else any link there; broken links are joined."""
    near = F.regexp_replace(F.coalesce(R.line_window(text, r"(?iu)audi[êe]ncia", 0, 10), F.lit("")), r"(https?://\S*[-/=_.])\s*\n\s*(\S+)", "$1$2")
    host = F.regexp_extract(near, r"(?i)https?://[^\s<>\"')]*(?:zoom\.us|teams\.|meet\.google|webex|jitsi)[^\s<>\"')]*", 0)
    return F.coalesce(F.nullif(host, F.lit("")), F.nullif(F.regexp_extract(near, LINK, 0), F.lit("")))


def hearing_kind(text: Column) -> Column:
    return T.first_match(R.line_window(text, r"(?iu)audi[êe]ncia", 3, 5), HEARING_KIND)


def hearing_people(text: Column) -> Column:
    return T.first_match(R.line_window(text, r"(?iu)audi[êe]ncia", 5, 5), [("preposto.*advogado|advogado.*preposto", "Preposto e Advogado"), ("preposto", "Preposto"), ("testemunha", "Testemunhas"), ("advogado", "Advogado")])


PACK = register(
    RulePack(
        "labour_br",
        (
            Rule("case_number", r"(\b\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}\b)", 1),
            Rule("case_number", r"(?<!\d)(\d{20})(?!\d)", 1, form=T.case_number_canonical),
            Rule("old_number", r"(?<![\d/.-])(\d{1,6}/(?:19|20)\d{2})\b", 1),
            Rule("state", "", column=state_ladder),
            Rule("court", "", column=lambda x: court(x)["court"]),
            Rule("origin", "", column=lambda x: court(x)["origin"]),
            Rule("instance", "", column=lambda x: court(x)["instance"]),
            *(Rule("district", I + p, (1, 2), "clean", form=lambda v: F.regexp_replace(v, r"\s+([A-Za-z]{2})$", " - $1"), plain=True) for p in DISTRICT),
            Rule("district", "", column=court_city),
            *(Rule("bench", I + p, 1, "clean", form=T.clean_value, plain=True) for p in BENCH),
            *(Rule("forum", I + p, 1, "clean", form=T.clean_value, plain=True) for p in FORUM),
            *(Rule("cell", I + p, 1, "clean", form=T.clean_value, plain=True) for p in CELL),
            *_dates("filing_date", FILING),
            *(Rule("claim_value", I + p, 1) for p in VALUE),
            *(Rule("hearing", I + p, (1, 2), "clean", form=hearing_form, plain=True) for p in HEARING),
            Rule("hearing", I + HEARING_LAST, (1, 2), "clean", form=hearing_form, plain=True, veto=HEARING_VETO),
            Rule("hearing_link", "", column=hearing_link, needs=(r"(?iu)audi[êe]ncia",)),
            Rule("hearing_kind", "", column=hearing_kind, needs=(r"(?iu)audi[êe]ncia",)),
            Rule("hearing_people", "", column=hearing_people, needs=(r"(?iu)audi[êe]ncia",)),
            Rule("plaintiff", "", column=party("plaintiff"), needs=(PARTY["plaintiff"],)),
            Rule("defendant", "", column=party("defendant")),
            Rule("plaintiff_lawyer", "", column=lawyer("plaintiff"), needs=("ADVOGAD",)),
            Rule("defendant_lawyer", "", column=lawyer("defendant"), needs=("ADVOGAD",)),
            Rule("bar_number", "", column=bar_number, needs=("OAB",)),
            Rule("phone", "", column=contact(r"\(?\d{2}\)?\s?9?\d{4}[-\s]?\d{4}")),
            Rule("email", "", column=contact(r"[\w.+-]+@[\w-]+\.[\w.-]+\w", GENERIC_MAIL)),
            Rule("cpf", "", column=contact(r"\d{3}\.\d{3}\.\d{3}-\d{2}")),
            *(Rule("deadline", I + p, (1, 2)) for p in DEADLINE),
            *_dates("hire_date", HIRED_TABLE, veto=DATE_VETO),
            *_dates("hire_date", HIRED_STORY, veto=DATE_VETO),
            *(Rule("hire_date", I + p, 1, "clean", form=T.parse_written_date, accept=T.date_in_format) for p in HIRED_WRITTEN),
            *_dates("hire_date", HIRED_PERIOD),
            *_dates("dismissal_date", LEFT_TABLE, veto=LEFT_VETO),
            *_dates("dismissal_date", LEFT_STORY, veto=LEFT_VETO),
            *(Rule("dismissal_date", I + p, 1, "clean", form=T.parse_written_date, accept=T.date_in_format) for p in LEFT_WRITTEN),
            *_dates("dismissal_date", LEFT_PERIOD),
            *(Rule("salary", I + p, 1, "money", form=salary_form, plain=True) for p in (*SALARY_FORM, *SALARY_PAID)),
            *(Rule("salary", I + p, 1, "money", form=salary_form, plain=True, veto=SALARY_VETO, around=60) for p in SALARY_ANY),
            Rule("salary", "", source="money", column=salary_fallback),
            Rule("job_title", "", column=job_title, needs=tuple(I + p for p in JOB)),
            *(Rule("pis", I + p, 1, "line", form=pis_form, plain=True) for p in PIS),
            *(Rule("ctps", I + p, 1, "line", form=T.clean_value, plain=True) for p in CTPS),
            Rule("ctps", I + CTPS_DIGITAL, 1, "line"),
            *(Rule("workplace", I + p, 1, form=T.clean_value, accept=lambda v: v.rlike(ADDRESS) & ~v.rlike(WORKPLACE_VETO)) for p in WORKPLACE),
            *(Rule("employer", I + p, 1, form=T.clean_value, plain=True) for p in EMPLOYER),
            Rule("employer", "", column=party("defendant")),
            Rule("dismissal_reason", "", column=dismissal_reason, needs=tuple(I + p for p, _ in DISMISSAL)),
            Rule("decision_type", "", column=decision_type),
            Rule("decision_result", "", column=decision_result),
            Rule("decision_reason", "", column=decision_reason),
        ),
        {
            "clean": T.clean_text,
        },
        {
            "money": ("clean", T.clean_money),
            "line": ("clean", lambda c: F.regexp_replace(c, r"\s+", " ")),
        },
    )
)
