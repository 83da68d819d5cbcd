"""Enrichment plugins as columns, their registry and pipelines, and the parsing side of model calls."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmill.functions.text import strip, words

Plugin = Callable[[Column], Column]
REGISTRY: dict[str, Plugin] = {}


def register(name: str) -> Callable[[Plugin], Plugin]:
    def put(plugin: Plugin) -> Plugin:
        REGISTRY[name] = plugin
        return plugin

    return put


def unregister(name: str) -> None:
    REGISTRY.pop(name, None)


# The patterns, words and labels results must agree on; of a list the first that matches counts.
CEO = (r"CEO[:\s]+([A-Z][a-z]+ [A-Z][a-z]+)", r"Chief Executive Officer[:\s]+([A-Z][a-z]+ [A-Z][a-z]+)", r"founder[:\s]+([A-Z][a-z]+ [A-Z][a-z]+)", r"founded by ([A-Z][a-z]+ [A-Z][a-z]+)")
REVENUE = (r"revenue[:\s]+\$?([\d.]+)\s*(billion|million|B|M)", r"annual revenue[:\s]+\$?([\d.]+)\s*(billion|million|B|M)", r"\$?([\d.]+)\s*(billion|million|B|M)\s+in revenue")
EMPLOYEES = (r"(\d+[\d,]*)\s+employees", r"employee count[:\s]+(\d+[\d,]*)", r"workforce of (\d+[\d,]*)")
FOUNDED = (r"founded in (\d{4})", r"established in (\d{4})", r"since (\d{4})")
PLACE = r"([A-Z][a-z]+(?:,?\s+[A-Z][a-z]+)*)"
HEADQUARTERS = (rf"headquartered in {PLACE}", rf"headquarters[:\s]+{PLACE}", rf"based in {PLACE}")
MARKET_CAP = (r"market cap[italization]*[:\s]+\$?([\d.]+)\s*(billion|million|trillion|B|M|T)", r"valued at \$?([\d.]+)\s*(billion|million|trillion|B|M|T)")
PROFIT = (r"profit[:\s]+\$?([\d.]+)\s*(billion|million|B|M)", r"net income[:\s]+\$?([\d.]+)\s*(billion|million|B|M)")
GROWTH = (r"(\d+)%\s+(?:annual\s+)?growth", r"growing at (\d+)%", r"growth rate[:\s]+(\d+)%")
INDUSTRIES = (
    ("technology", ("software", "tech", "saas", "cloud", "ai", "machine learning")), ("finance", ("bank", "financial", "fintech", "investment", "insurance")),
    ("healthcare", ("health", "medical", "pharmaceutical", "biotech", "hospital")), ("retail", ("retail", "e-commerce", "ecommerce", "shopping", "store")),
    ("manufacturing", ("manufacturing", "factory", "industrial", "production")), ("energy", ("energy", "oil", "gas", "renewable", "solar", "wind")),
    ("telecommunications", ("telecom", "wireless", "network", "broadband")), ("automotive", ("automotive", "car", "vehicle", "transportation")),
)
NAME = (r"(?m)^([A-Z][a-z]+ [A-Z][a-z]+)", r"I'm ([A-Z][a-z]+ [A-Z][a-z]+)", r"My name is ([A-Z][a-z]+ [A-Z][a-z]+)")
WORKPLACE = (r"(?:works at|working at) ([A-Z][a-zA-Z\s&]+)", r"(?:employed by|employee of) ([A-Z][a-zA-Z\s&]+)", r"at ([A-Z][a-zA-Z\s&]+) (?:since|as)")
LOCATION = (rf"based in {PLACE}", rf"lives in {PLACE}", rf"located in {PLACE}")
EDUCATION = (r"(?:graduated from|degree from|studied at) ([A-Z][a-zA-Z\s]+(?:University|College|Institute))", r"([A-Z][a-zA-Z\s]+(?:University|College|Institute)) (?:graduate|alumni)")
EMAIL = r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
PHONE = (r"(\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4})", r"(\+1[-.\s]?\d{3}[-.\s]?\d{3}[-.\s]?\d{4})")
YEARS = (r"(\d+)\+?\s+years of experience", r"over (\d+) years", r"(\d+) years in")
SKILLS = (
    "python", "javascript", "java", "c++", "rust", "go", "machine learning", "ai", "deep learning", "react", "angular", "vue", "aws", "azure", "gcp", "cloud",
    "docker", "kubernetes", "sql", "nosql", "mongodb", "postgresql", "agile", "scrum", "devops",
)


def _first(text: Column, patterns: Sequence[str], group: int = 1, any_case: bool = True) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(text, ("(?i)" if any_case else "") + p, group), F.lit("")) for p in patterns))


def _money(text: Column, patterns: Sequence[str]) -> Column:
    """An amount with one letter for its unit."""
    return F.concat(F.lit("$"), _first(text, patterns), F.upper(F.substring(_first(text, patterns, 2), 1, 1)))


@register("company")
def company(text: Column) -> Column:
    low = F.lower(text)
    has = lambda ws: F.when(low.rlike("|".join(w.replace("-", "\\-") for w in ws)), True)
    industry = F.coalesce(*(F.when(has(ws), F.lit(name)) for name, ws in INDUSTRIES))
    return F.struct(
        _first(text, CEO).alias("ceo"), _money(text, REVENUE).alias("revenue"), F.replace(_first(text, EMPLOYEES), F.lit(",")).alias("employees"), _first(text, FOUNDED).alias("founded"),
        _first(text, HEADQUARTERS, any_case=False).alias("headquarters"), industry.alias("industry"), _money(text, MARKET_CAP).alias("market_cap"), _money(text, PROFIT).alias("profit"), _first(text, GROWTH).alias("growth_rate"),
    )


@register("person")
def person(text: Column) -> Column:
    low = F.lower(text)
    return F.struct(
        _first(text, NAME, any_case=False).alias("name"), strip(_first(text, WORKPLACE, any_case=False)).alias("company"), _first(text, LOCATION, any_case=False).alias("location"),
        strip(_first(text, EDUCATION, any_case=False)).alias("education"), _first(text, (EMAIL,), any_case=False).alias("email"), _first(text, PHONE, any_case=False).alias("phone"), _first(text, YEARS).alias("years"),
        F.array_join(F.filter(F.array(*map(F.lit, SKILLS)), lambda s: F.contains(low, s)), ",").alias("skills"),
    )


@register("summary")
def summary(text: Column) -> Column:
    w = F.split(strip(text), r"\s+")
    short = F.when(F.size(w) > 200, F.concat(F.array_join(F.slice(w, 1, 200), " "), F.lit("..."))).otherwise(text)
    return F.struct(short.alias("summary"), F.size(words(text)).alias("n_words"), F.length(text).alias("n_chars"))


def enrich(df: DataFrame, text: str, plugins: Sequence[str], when: dict[str, Column] | None = None) -> DataFrame:
    """A column for each plugin: struct(success, data as JSON, error). Blank texts fail with "Invalid input", unknown plugins with
    "Unknown plugin"; a plugin whose condition in ``when`` is false is skipped (null). Conditions may use earlier results."""
    for name in plugins:
        blank = ~F.coalesce(strip(F.col(text)) != "", F.lit(False))
        fail = lambda message: F.struct(F.lit(False).alias("success"), F.lit(None).cast("string").alias("data"), F.lit(message).alias("error"))
        if name in REGISTRY:
            result = F.when(blank, fail("Invalid input")).otherwise(
                F.struct(F.lit(True).alias("success"), F.to_json(REGISTRY[name](F.col(text))).alias("data"), F.lit(None).cast("string").alias("error"))
            )
        else:
            result = fail("Unknown plugin")
        condition = (when or {}).get(name)
        df = df.withColumn(name, F.when(condition, result) if condition is not None else result)
    return df


def enrich_once(df: DataFrame, text: str, plugins: Sequence[str]) -> DataFrame:
    """(digest, plugin columns) of each distinct text: copies are enriched once."""
    once = df.select(F.sha2(text, 256).alias("digest"), F.col(text)).groupBy("digest").agg(F.first(text).alias(text))
    return enrich(once, text, plugins).drop(text)


def parse_list(answer: Column) -> Column:
    """Items of a listed answer: bullets and numbers stripped, blanks dropped."""
    lines = F.transform(F.split(answer, "\n"), lambda x: strip(F.regexp_replace(F.regexp_replace(strip(x), "^[-*•►▪▸]+", ""), r"^\s*\d+[.)]\s*", "")))
    return F.filter(lines, lambda x: x != "")


def parse_json(answer: Column, schema: str) -> Column:
    """An answer as a struct; bad JSON gives null fields."""
    return F.from_json(F.regexp_replace(answer, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""), schema)


def prompt(template: str, **parts: Column) -> Column:
    """A prompt column: ``{name}`` in the template is replaced by the column of that name."""
    out = F.lit(template)
    for name, column in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(column, F.lit("")))
    return out


def cheapest_model(models: DataFrame, capability: str, most: float | None = None) -> DataFrame:
    """The model with a capability and the lowest price."""
    able = models.filter(F.array_contains("capabilities", capability))
    if most is not None:
        able = able.filter(F.col("price_in") <= most)
    return able.orderBy("price_in", "name").limit(1)


def usage_cost(usage: DataFrame, models: DataFrame) -> DataFrame:
    """Requests, tokens and cost of each model: tokens / 2000 * (input + output price)."""
    priced = usage.join(F.broadcast(models.select("name", "price_in", "price_out").limit(1000)), "name")
    cost = F.col("tokens") / 2000 * (F.col("price_in") + F.col("price_out"))
    return priced.groupBy("name").agg(F.count(F.lit(1)).alias("n_requests"), F.sum("tokens").cast("long").alias("tokens"), F.round(F.sum(cost), 6).alias("cost"))
