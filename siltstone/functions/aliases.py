"""Drug names and the other names they go by."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Each drug and the names that stand for it, in order of precedence.
NAMES: dict[str, list[str]] = {
    "levetiracetam": ["levetiracetam", "keppra", "lev"],
    "lamotrigine": ["lamotrigine", "lamictal", "ltg"],
    "valproate": ["valproate", "valproic acid", "sodium valproate", "depakote", "depakene", "divalproex", "valproic", "vpa"],
    "carbamazepine": ["carbamazepine", "tegretol", "carbatrol", "epitol", "cbz"],
    "phenytoin": ["phenytoin", "dilantin", "phenytek", "pht"],
    "topiramate": ["topiramate", "topamax", "tpm"],
    "gabapentin": ["gabapentin", "neurontin", "gbp"],
    "oxcarbazepine": ["oxcarbazepine", "trileptal", "oxc"],
    "zonisamide": ["zonisamide", "zonegran"],
    "lacosamide": ["lacosamide", "vimpat"],
    "pregabalin": ["pregabalin", "lyrica"],
    "clonazepam": ["clonazepam", "klonopin"],
    "diazepam": ["diazepam", "valium"],
    "lorazepam": ["lorazepam", "ativan"],
    "alprazolam": ["alprazolam", "xanax"],
    "bupropion": ["bupropion", "wellbutrin", "zyban"],
    "sertraline": ["sertraline", "zoloft"],
    "fluoxetine": ["fluoxetine", "prozac"],
    "escitalopram": ["escitalopram", "lexapro"],
    "citalopram": ["citalopram", "celexa"],
    "venlafaxine": ["venlafaxine", "effexor"],
    "duloxetine": ["duloxetine", "cymbalta"],
    "amitriptyline": ["amitriptyline", "elavil"],
    "nortriptyline": ["nortriptyline", "pamelor"],
    "imipramine": ["imipramine", "tofranil"],
    "desipramine": ["desipramine", "norpramin"],
    "lithium": ["lithium", "lithobid", "eskalith"],
    "risperidone": ["risperidone", "risperdal"],
    "olanzapine": ["olanzapine", "zyprexa"],
    "quetiapine": ["quetiapine", "seroquel"],
    "aripiprazole": ["aripiprazole", "abilify"],
    "ziprasidone": ["ziprasidone", "geodon"],
    "haloperidol": ["haloperidol", "haldol"],
    "chlorpromazine": ["chlorpromazine", "thorazine"],
    "clozapine": ["clozapine", "clozaril"],
    "methylphenidate": ["methylphenidate", "ritalin", "concerta"],
    "amphetamine": ["amphetamine", "adderall", "dexedrine"],
    "atomoxetine": ["atomoxetine", "strattera"],
    "guanfacine": ["guanfacine", "tenex", "intuniv"],
    "clonidine": ["clonidine", "catapres", "kapvay"],
    "donepezil": ["donepezil", "aricept"],
    "rivastigmine": ["rivastigmine", "exelon"],
    "galantamine": ["galantamine", "razadyne"],
    "memantine": ["memantine", "namenda"],
    "trazodone": ["trazodone", "desyrel"],
    "mirtazapine": ["mirtazapine", "remeron"],
    "nefazodone": ["nefazodone", "serzone"],
    "vilazodone": ["vilazodone", "viibryd"],
    "vortioxetine": ["vortioxetine", "brintellix", "trintellix"],
    "buspirone": ["buspirone", "buspar"],
    "hydroxyzine": ["hydroxyzine", "atarax", "vistaril"],
}


def aliases(spark: SparkSession) -> DataFrame:
    """priority, canonical, alias_pos, alias: a row per name. A fixed table of about 130 rows."""
    rows = [(p, c, k, a) for p, (c, names) in enumerate(NAMES.items()) for k, a in enumerate(names)]
    return spark.createDataFrame(rows, "priority int, canonical string, alias_pos int, alias string")


def normal(term: Column) -> Column:
    """Trimmed, lower-cased, white space runs made one space; null becomes empty."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_replace(term, r"(?U)^\s+|\s+$", "")), r"(?U)\s+", " "), F.lit(""))


def _lookup(key: Column, pairs: dict[str, object], empty: Column) -> Column:
    """The value of a fixed small dictionary, or `empty`."""
    flat = [x for k, v in pairs.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*flat), key), empty)


def canonical(term: Column) -> Column:
    """The canonical name of any name; an unknown name is its own."""
    name = normal(term)
    return _lookup(name, {a: c for c, names in NAMES.items() for a in names}, name)


def search_terms(term: Column) -> Column:
    """All names of a drug, the canonical one first; an unknown name alone; none for empty terms."""
    c = canonical(term)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(_lookup(c, NAMES, F.array(c)))


def contains_any(text: Column, terms: list[str], whole_words: bool = False) -> Column:
    """Whether one of the terms is a substring of the text or, if asked for, one of its words."""
    if whole_words:
        return text.rlike(r"(?U)\b(?:" + "|".join(terms) + r")\b")
    return reduce(lambda a, t: a | text.contains(t), terms, F.lit(False))


def first_named(text: Column, whole_words: bool = False) -> Column:
    """The first drug, in order of precedence, one of whose names is in the (lower-cased) text."""
    return F.coalesce(*[F.when(contains_any(text, names, whole_words), F.lit(c)) for c, names in NAMES.items()])


def expand(query: Column) -> Column:
    """The query followed by every name of every drug that it names, each once, all by single spaces."""
    q = normal(query)
    parts = [query]
    for names in NAMES.values():
        more = [F.when(q != a, F.lit(a)) for a in names]
        parts.append(F.when(contains_any(q, names), F.concat_ws(" ", *more)))
    return F.concat_ws(" ", *parts)
