"""From what readers give to records of the evidence contract.

``query``: what the operator asked for (company, kind of event, category), which the records take over as structure. Every
connector has a name, an origin of its statements and, where its payloads don't name one, an outlet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.functions.text import contract_hash, plain_text

#: Connector -> (origin of its statements, outlet where none is named, kind of event if it is structural).
CONNECTORS = {"noticias": ("prensa", "Google News", None), "articulos": ("prensa", "", None), "fijos": ("prensa", "", None), "vacantes": ("operador", "", "contratacion")}


def records(items: DataFrame, connector: str, company: Column, event: Column, now: Column) -> DataFrame:
    """Contract rows of reader rows (``titulo``, ``url``, ``medio``, ``fecha``); a missing date stays null (undated)."""
    origin, outlet, structural = CONNECTORS[connector]
    named = F.trim(F.coalesce("medio", F.lit("")))
    return items.select(
        F.trim("titulo").alias("cita_textual"), now.alias("fecha_extraccion"), F.trim("url").alias("url_fuente"), F.when(named == "", outlet).otherwise(named).alias("nombre_medio"), company.alias("empresa_mencionada"),
        (F.lit(structural) if structural else event).alias("tipo_evento"), F.lit(origin).alias("origen_declaracion"), contract_hash(company, F.col("url")).alias("hash_dedup"),
        F.date_format("fecha", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("fecha_publicacion"), F.lit(None).cast("string").alias("persona_citada"), F.lit(connector).alias("connector"),
    )


def pushes(items: DataFrame, org: Column) -> DataFrame:
    """Payloads (``texto``, ``url``, ``org_name``) of feed items for the signal engine: title and summary without tags; items without text are left out."""
    text = F.trim(F.concat_ws(". ", F.trim("titulo"), F.nullif(plain_text(F.col("resumen")), F.lit(""))))
    return items.select(text.alias("texto"), "url", org.alias("org_name")).where("texto <> ''")


#: Countries of a region, and what a region sets in a feed address.
COUNTRIES = ("México", "Colombia", "Chile", "Perú", "Argentina", "Brasil", "Costa Rica", "Panamá")


def region_clause(region: str | None) -> str:
    """Clause of a region for a search: its countries joined by OR, quoted if they have a blank; '' for an unknown region."""
    names = COUNTRIES if region == "LATAM" else (region,) if region in COUNTRIES else ()
    return "(" + " OR ".join(f'"{n}"' if " " in n else n for n in names) + ")" if names else ""


def article_query(base: str, company: Column, exact: Column, country: str | None = None, most: int = 75) -> Column:
    """Address of an article search; ``most`` is kept between 1 and 250."""
    q = F.when(exact, F.concat(F.lit('"'), company, F.lit('"'))).otherwise(company)
    if country:
        q = F.concat(q, F.lit(f" sourcecountry:{country}"))
    return F.concat(F.lit(f"{base}?query="), F.url_encode(q), F.lit(f"&mode=ArtList&format=json&maxrecords={max(1, min(most, 250))}&sort=DateDesc"))
