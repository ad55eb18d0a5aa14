"""Rules for any corpus: contact data, addresses of machines, dates in ISO form."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.operators.rules import Rule, RulePack, register

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
PHONE = r"\+?\d{1,3}[ .-]\(?\d{2,4}\)?[ .-]\d{3,4}[ .-]?\d{3,4}"


def _octets(c):
    return F.forall(F.split(c, r"\."), lambda o: o.cast("int") <= 255)


PACK = register(
    RulePack(
        "generic",
        (
            Rule("email", EMAIL, 0),
            Rule("ipv4", IPV4, 0, accept=_octets),
            Rule("phone", PHONE, 0),
            Rule("iso_date", r"\b(\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]))\b", 1),
        ),
    )
)
