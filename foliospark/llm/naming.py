"""One person, organisation or product under many spellings.

Every name is rewritten by rules — letter forms, token order, nickname, initial,
legal form, abbreviation, edition, one-letter slips — and each rewriting is a
form.  Forms are exploded and equi-joined; how rare a rewriting is decides what
it may prove: a nickname, an initial or a dropped edition links only where a
single fuller spelling has that form, and a one-letter slip is none between two
tokens of which neither is rare beside the other.  Linked spellings are then joined to components
(persons known only by initials are attached last).

What makes a name that of an organisation is learnt beside a short list: words
that stand with an article, a preposition or a legal form beside several
different other words; and a shorter word stands for a learnt one if it is the
only one it can shorten.

Everything works on distinct spellings, so a spelling that fills a third of all
rows is one row here.

Defined results: NULL, '' and blank names are left out; equal strings are one
spelling; a name that no rule reads (no letters or digits) stands for itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.appearance import LOOKS, Form, normaliser
from foliospark.session import checkpointed

# Short forms of given names, and what they may stand for.
NICKNAMES = {
    "alex": "alexander alexandra alexandre", "sasha": "alexander alexandra", "sascha": "alexander alexandra", "sandy": "alexander alexandra", "toni": "antonio anton antonia", "tony": "antonio anthony", "bea": "beatriz beatrice", "trixi": "beatrix beatriz",
    "kate": "catherine katherine katharina", "cathy": "catherine", "kathy": "catherine katherine", "cat": "catherine", "kathi": "katharina katherine", "kati": "katharina", "katja": "katharina", "dora": "dorothea theodora", "thea": "dorothea", "dot": "dorothea", "dolly": "dorothea",
    "ed": "edouard edward edgar edmund", "eddie": "edouard edward", "edi": "edouard eduard", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lisa": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth", "paco": "francisco", "pancho": "francisco", "fran": "francisco frances", "curro": "francisco",
    "fred": "frederic frederick alfred", "freddy": "frederic frederick", "fritz": "friedrich frederic", "gabi": "gabriele gabriela", "gaby": "gabriele gabriela", "beppe": "giuseppe", "peppe": "giuseppe", "pino": "giuseppe", "beppo": "giuseppe", "leni": "helene magdalena", "nell": "helene helen", "lena": "helene magdalena",
    "nacho": "ignacio", "iggy": "ignacio", "hans": "johannes", "jan": "johannes", "johann": "johannes", "hannes": "johannes", "pepe": "jose", "chepe": "jose", "jupp": "josef", "jorg": "jurgen", "kostja": "konstantin", "kostya": "konstantin", "kosta": "konstantin", "conny": "konstantin cornelia",
    "renzo": "lorenzo", "enzo": "lorenzo vincenzo", "lori": "lorenzo", "mila": "ludmila milena", "lida": "ludmila lidia", "luda": "ludmila", "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "greta": "margaret margarete", "mari": "maria", "mia": "maria", "marie": "maria", "mitzi": "maria",
    "mike": "michael", "mick": "michael", "mickey": "michael", "michi": "michael", "klaus": "nikolaus", "niko": "nikolaus", "nick": "nikolaus nicholas", "claus": "nikolaus", "pippa": "philippa", "pip": "philippa philip", "rafa": "raphael rafael", "raf": "raphael", "raffi": "raphael", "bob": "robert", "rob": "robert", "bert": "robert albert", "robbie": "robert",
    "tess": "therese theresa", "resi": "therese", "tessa": "therese theresa", "ted": "theodore edward", "theo": "theodore theodor", "teddy": "theodore", "tim": "timothy", "timmy": "timothy", "uli": "ulrike ulrich", "ulla": "ulrike ursula", "rike": "ulrike friederike", "vince": "vincent", "vinnie": "vincent", "vin": "vincent",
    "bill": "william", "will": "william", "billy": "william", "willy": "william wilhelm", "liam": "william", "wolf": "wolfgang", "wolfi": "wolfgang", "yoli": "yolanda", "yola": "yolanda", "zo": "zoe",
}

# Titles; legal forms; words of organisations with their short forms and other spellings; editions.
TITLES = frozenset("dr prof mr mrs ms miss sir jr sr phd md dipl ing mag herr frau mme m mlle sig dott don dona".split()) - {"m"}
LEGAL = frozenset("gmbh ltd limited inc incorporated llc llp co corp corporation company ag sa sas sarl plc kg ohg bv nv oy ab as aps spa srl ev kgaa se pty".split())
FILLERS = frozenset("the of for and de la le les der die das des von fur du et y e by from with".split())
ORGANISATION = {
    "institute": "inst institut instituto", "university": "univ universitat universite universidad", "library": "lib libr bibliothek", "publishing": "publ pub publg", "house": "hse", "office": "off offc", "authority": "auth authy", "harbour": "hbr harbor hrbr", "trust": "tr", "survey": "surv svy",
    "canal": "canals", "hydrography": "hydrogr hydr", "society": "soc", "association": "assoc assn", "department": "dept dep", "ministry": "min", "council": "cncl", "committee": "cttee", "commission": "comm", "museum": "mus", "archive": "arch archives", "press": "", "bank": "", "group": "grp", "bureau": "", "agency": "agcy", "foundation": "fdn", "school": "sch", "college": "coll", "service": "svc services", "centre": "center ctr", "laboratory": "lab labs", "board": "bd", "academy": "acad", "union": "", "club": "",
}
EDITIONS = frozenset("server pro professional es se le lite light standard enterprise edition ultimate home personal business premium plus desktop trial free express basic student academic ee ce cs suite".split())
VERSION_WORDS = frozenset("v ver version build release rel beta alpha rc update bit win windows mac macos linux".split())
ALIASES = (("command line interface", "cli"), ("command line", "cli"), ("graphical user interface", "gui"), ("software development kit", "sdk"))

_ORG_WORD = {s: full for full, short in ORGANISATION.items() for s in (full, *short.split())}
_LOOK = normaliser(Form(compatibility=LOOKS.compatibility, fold_case=False, skeleton=True, keep_space=True))
_LETTERS = str.maketrans({"ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z][a-z])")
SEP = " "


def fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.lower().translate(_LETTERS))
    return "".join(c for c in text if not unicodedata.combining(c)).translate(_LETTERS)


def deletions(token: str) -> list[str]:
    return list({token, *(token[:i] + token[i + 1 :] for i in range(len(token)))})


def _slips(tokens: list[str], least: int) -> list[tuple[str, str]]:
    """(form, token) for one-letter slips: the other tokens with each deletion of this one."""
    out = []
    for i, t in enumerate(tokens):
        if len(t) >= least:
            rest = SEP.join(tokens[:i] + tokens[i + 1 :])
            out += [(f"{rest}|{d}", t) for d in deletions(t)]
    return out


def _shortenings(tokens: list[str]) -> list[tuple[str, str]]:
    """(form, token): the other tokens with the first letter of this one."""
    if len(tokens) < 2:
        return []
    return [(f"{SEP.join(tokens[:i] + tokens[i + 1 :])}|{t[0]}", t) for i, t in enumerate(tokens) if len(t) > 1]


def parse_product(name: str) -> dict:
    text = _CAMEL.sub(" ", re.sub(r"[®™©]", " ", _LOOK(name)))
    text = f" {SEP.join(re.findall(r'[^\W_]+', fold(text)))} "
    for long, short in ALIASES:
        text = text.replace(f" {long} ", f" {short} ")
    tokens = [t for t in text.split() if not any(c.isdigit() for c in t) and t not in VERSION_WORDS and t not in LEGAL - {"se"} and t not in FILLERS - {"e", "y"}]
    if not tokens:
        tokens = text.split()
    tokens = [t[:-1] if len(t) > 3 and t.endswith("s") and not t.endswith("ss") else t for t in tokens]
    tokens = ["lib" if t == "library" else t for t in tokens]
    key = SEP.join(sorted(tokens))
    compact = [f"c:{''.join(tokens[i:] + tokens[:i])}" for i in range(len(tokens))]
    weak = []
    for i, t in enumerate(tokens):
        if t in EDITIONS and len(tokens) > 2:
            weak.append(SEP.join(sorted(tokens[:i] + tokens[i + 1 :])))
    whole = "".join(tokens)
    slips = _slips(sorted(tokens), 5 if len(tokens) > 1 else 8)
    if len(tokens) > 1 or not whole:
        slips += [(f"|{d}", whole) for d in deletions(whole)] if len(whole) >= 8 else []
    return {"kind": "product", "key": key, "alts": compact, "weak": weak, "slips": slips, "shorts": _shortenings(sorted(tokens)), "tokens": sorted(set(tokens)), "seconds": [], "middle": None}


# Words that stand in names of organisations and not of persons.
CUES = frozenset("of the for and fur y".split())
#: Other words a learnt word must be seen with; and the share of such names that a word must be in, as one in so many.
PARTNERS, WORD_SHARE = 3, 1 << 14


def _words_of(name: str) -> list[str]:
    return re.findall(r"[^\W_]+", re.sub(r"-+", "-", fold(_LOOK(name))))


def organisation_words(names: DataFrame) -> frozenset[str]:
    """Words of organisations beyond the list, from names with a cue.

    At most a few for each WORD_SHARE of the names with a cue reach the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name in pdf["name"]:
                words = _words_of(name)
                rest = sorted({w for w in words if len(w) > 2 and w not in CUES and w not in FILLERS and w not in LEGAL})
                if 2 <= len(rest) <= 8 and any(w in CUES or (w in LEGAL and len(w) > 2) for w in words):
                    rows += [(w, SEP.join(x for x in rest if x != w)) for w in rest]
            yield pd.DataFrame(rows, columns=["word", "rest"])

    pairs = names.mapInPandas(run, "word string, rest string").distinct()
    counts = checkpointed(pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    whole = counts.agg(F.sum("n")).first()[0] or 0
    return frozenset(r.word for r in counts.where((F.col("n") >= PARTNERS) & (F.col("n") * WORD_SHARE >= whole)).collect())


@lru_cache(maxsize=1 << 16)
def shortened(word: str, words: frozenset[str]) -> str | None:
    """The only learnt word that ``word`` can be short for: its letters in order, the first one first."""
    if len(word) < 2 or word in words:
        return None
    pattern = re.compile(re.escape(word[0]) + "".join(".*" + re.escape(c) for c in word[1:]))
    found = [w for w in words if len(w) > len(word) and w[0] == word[0] and pattern.match(w)]
    return found[0] if len(found) == 1 else None


def parse_person(name: str, learnt: frozenset[str] = frozenset()) -> dict:
    """A person, or an organisation where a word says so."""
    text = fold(_LOOK(name))
    text = re.sub(r"-+", "-", text)
    words = re.findall(r"[^\W_]+", text)
    short = {w: full for w in words if len(w) > 2 and w not in TITLES and re.search(rf"\b{w}\.", text) and (full := shortened(w, learnt))} if learnt else {}
    if short or any(w in ORGANISATION or w in learnt for w in words) or any(w in _ORG_WORD and re.search(rf"\b{w}\.", text) for w in words) or any(w in LEGAL and len(w) > 2 for w in words):
        tokens = sorted(_ORG_WORD.get(w) or short.get(w, w) for w in words if w not in LEGAL and w not in FILLERS) or words
        return {"kind": "organisation", "key": "o:" + SEP.join(tokens), "alts": [], "weak": [], "slips": [("o:" + f, t) for f, t in _slips(tokens, 5)], "shorts": [("o:" + f, t) for f, t in _shortenings(tokens)], "tokens": tokens, "seconds": [], "middle": None}
    parts = [re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", p) for p in text.split(",")]
    parts = [[w for w in p if w not in TITLES] for p in parts]
    parts = [p for p in parts if p]
    words = [w for p in parts for w in p]
    full, initials = [w for w in words if len(w) > 1], [w for w in words if len(w) == 1]
    out = {"kind": "person", "key": None, "alts": [], "weak": [], "slips": [], "shorts": [], "tokens": [], "seconds": [], "middle": None}
    if not full:
        return out | {"key": SEP.join(words) or name}
    left = [w for w in parts[0] if len(w) > 1]
    if len(parts) > 1 and len(left) > 1:  # a surname of several parts before the comma
        full = ["-".join(left), *(w for w in full if w not in left)]
    if initials and (len(full) == 1 or (len(parts) > 1 and not any(len(w) > 1 for p in parts[1:] for w in p)) or (len(full) == 2 and len(initials) > 1 and "," not in text)):
        # Only initials beside the surname.
        surname = "-".join(full)
        return out | {"seconds": [f"{surname}|{initials[0]}"], "middle": initials[1] if len(initials) > 1 else None, "slips": [(f"{d}|{initials[0]}", surname) for d in deletions(surname)] if len(surname) >= 6 else []}
    options = [full]
    if len(full) == 3:
        options = [[f"{full[0]}-{full[1]}", full[2]], [full[0], f"{full[1]}-{full[2]}"]]
    keys = []
    for tokens in options:
        keys.append(SEP.join(sorted(tokens)))
        for i, t in enumerate(tokens):
            for canonical in NICKNAMES.get(t, "").split():
                out["weak"].append(SEP.join(sorted([*tokens[:i], canonical, *tokens[i + 1 :]])))
    tokens = sorted(options[0])
    seconds = []
    for option in options:
        for i, t in enumerate(option):
            rest = option[:i] + option[i + 1 :]
            if len(rest) == 1:
                seconds.append(f"{rest[0]}|{t[0]}")
    slips = [s for option in options for s in _slips(sorted(option), 4)]
    return out | {"key": keys[0], "alts": keys[1:], "slips": slips, "tokens": tokens, "seconds": seconds, "middle": initials[0] if initials else None}


_SCHEMA = (
    "field string, name string, n bigint, kind string, key string, alts array<string>, weak array<string>, "
    "slips array<struct<form: string, token: string>>, shorts array<struct<form: string, token: string>>, tokens array<string>, seconds array<string>, middle string"
)


def parsed(names: DataFrame, products: tuple[str, ...] = ("creator", "producer")) -> DataFrame:
    """The forms of every distinct (field, name)."""
    learnt = organisation_words(names.where(~F.col("field").isin(*products)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for field, name, n in zip(pdf["field"], pdf["name"], pdf["n"]):
                p = parse_product(name) if field in products else parse_person(name, learnt)
                p["slips"] = [{"form": a, "token": b} for a, b in p["slips"]]
                p["shorts"] = [{"form": a, "token": b} for a, b in p["shorts"]]
                rows.append({"field": field, "name": name, "n": n, **p})
            yield pd.DataFrame(rows, columns=["field", "name", "n", "kind", "key", "alts", "weak", "slips", "shorts", "tokens", "seconds", "middle"])

    return names.mapInPandas(run, _SCHEMA)


def components(edges: DataFrame) -> DataFrame:
    """(field, node, root): smallest node of each component, by label spreading and pointer jumping.

    Labels are combined before each shuffle; the number of rounds follows the
    logarithm of the longest chain of links.
    """
    both = edges.select("field", "a", "b").unionByName(edges.select("field", F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = checkpointed(both)
    label = checkpointed(both.groupBy("field", F.col("a").alias("node")).agg(F.min("b").alias("b")).select("field", "node", F.least("node", "b").alias("root")))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), ["field", "b"]).groupBy("field", F.col("a").alias("node")).agg(F.min("root").alias("near"))
        spread = label.join(near, ["field", "node"], "left").select("field", "node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = spread.select("field", F.col("node").alias("root"), F.col("root").alias("up"))
        new = checkpointed(spread.join(jump, ["field", "root"], "left").select("field", "node", "old", F.least("root", "up").alias("root")))
        changed = new.where("old <> root").limit(1).count()
        label = new.select("field", "node", "root")
        if not changed:
            return label


def _one_slip(a, b):
    """Whether two tokens sharing a deletion differ by one insertion, deletion, change or swap."""
    letters = lambda c: F.array_sort(F.split(c, ""))
    distance = F.levenshtein(a, b)
    return (distance == 1) | ((distance == 2) & (F.length(a) == F.length(b)) & (letters(a) == letters(b)))


#: Least rarity of a weak form that links: more than half, so a single holder.
RARE = 0.75
#: How often a token is slipped into one certain other, at most, as a share of its keys.
SLIP_RATE = 0.05


def _explained(fewer, more):
    """Whether slips of the commoner token account for the other keys of the rarer one.

    ``fewer`` and ``more`` count the keys each token has besides the pair's own.
    What slips give is a share of the commoner's keys, with the spread of a rare
    event, so the answer is one of proportions whatever the size of the table.
    """
    expected = more * SLIP_RATE
    return fewer <= expected + 2 * F.sqrt(expected) + 1


def entities(names: DataFrame, products: tuple[str, ...] = ("creator", "producer")) -> DataFrame:
    """(field, name, n, kind, entity) for ``names`` (field, name, n), distinct spellings."""
    forms = checkpointed(parsed(names, products))
    keyed = forms.where("key is not null")
    keys = keyed.groupBy("field", "key").agg(F.sum("n").alias("n"), F.first("tokens").alias("tokens"), F.first("kind").alias("kind"))

    hubs = keyed.select("field", F.col("key").alias("a"), F.explode("alts").alias("b"))
    # A weak form's rarity is one in as many spellings as have it for their own key; shared by several it proves nothing.
    weak = keyed.select("field", F.col("key").alias("a"), F.explode("weak").alias("b")).distinct()
    weak = weak.join(keys.select("field", F.col("key").alias("b")), ["field", "b"], "left_semi")
    weak = weak.groupBy("field", "a").agg((1 / F.count(F.lit(1))).alias("rarity"), F.min("b").alias("b")).where(F.col("rarity") >= RARE).select("field", "a", "b")

    tokens = keys.select("field", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("field", "token").agg((F.count(F.lit(1)) - 1).alias("others"))
    slips = keyed.select("field", "key", "kind", F.explode("slips").alias("s")).select("field", "key", "s.form", "s.token").distinct()
    slips = slips.join(tokens, ["field", "token"], "left").withColumn("others", F.coalesce("others", F.lit(0)))
    right = slips.select("field", "form", F.col("key").alias("b"), F.col("token").alias("t2"), F.col("others").alias("o2"))
    rare = _explained(F.least("others", "o2"), F.greatest("others", "o2"))
    pairs = slips.join(right, ["field", "form"]).where((F.col("key") < F.col("b")) & (F.col("token") != F.col("t2")) & rare & _one_slip("token", "t2"))
    slip_edges = pairs.select("field", F.col("key").alias("a"), "b")

    shorts = keyed.select("field", "key", "n", F.explode("shorts").alias("s")).select("field", "key", "n", "s.form", "s.token").groupBy("field", "key", "form", "token").agg(F.sum("n").alias("n"))
    long = shorts.select("field", "form", F.col("key").alias("b"), F.col("token").alias("t2"), F.col("n").alias("n2"))
    pattern = F.concat(F.lit("^"), F.array_join(F.split("token", ""), ".*"))
    met = shorts.join(long, ["field", "form"]).where((F.length("token") < F.length("t2")) & F.rlike("t2", pattern) & (F.length("token") >= 2))
    # Of several words a short form may stand for, the commonest.
    short_edges = met.groupBy("field", F.col("key").alias("a"), "form", "token").agg(F.max_by("b", F.struct("n2", "b")).alias("b")).select("field", "a", "b")

    root = components(hubs.unionByName(weak).unionByName(slip_edges).unionByName(short_edges))
    known = keyed.join(root.withColumnRenamed("node", "key"), ["field", "key"], "left").select("field", "name", "n", "kind", F.coalesce("root", "key").alias("entity"), "seconds", "middle")
    known = checkpointed(known)

    # Initials: the entities that have the form, with the middle initials they are known by.
    seconds = known.select("field", "entity", "middle", F.explode("seconds").alias("form"))
    owners = seconds.groupBy("field", "form", "entity").agg(F.collect_set("middle").alias("middles"))
    bare = forms.where("key is null").select("field", "name", "n", "kind", F.col("seconds")[0].alias("form"), "middle", "slips")
    # A slip in the surname: the form as spelt by the only owner one slip away.
    unknown = bare.join(owners, ["field", "form"], "left_anti").select("field", "form", F.explode("slips").alias("s")).select("field", "form", F.col("s.form").alias("slip"), F.col("s.token").alias("token")).distinct()
    surname, initial = F.substring_index("form", "|", 1), F.substring_index("form", "|", -1)
    near = owners.select("field", "form", "entity", surname.alias("t2"), initial.alias("i")).distinct().where(F.length("t2") >= 6)
    cut = F.expr("transform(sequence(0, length(t2)), p -> concat(if(p = 0, t2, concat(substring(t2, 1, p - 1), substring(t2, p + 1))), '|', i))")
    near = near.select("field", "entity", F.col("form").alias("spelt"), "t2", F.explode(cut).alias("slip")).distinct()
    moved = unknown.join(near, ["field", "slip"]).where(_one_slip("token", "t2")).groupBy("field", "form").agg(F.min("spelt").alias("spelt"), F.min("entity").alias("e1"), F.max("entity").alias("e2")).where("e1 = e2").select("field", "form", "spelt")
    bare = bare.join(moved, ["field", "form"], "left").withColumn("form", F.coalesce("spelt", "form")).drop("spelt", "slips")
    # One owner: that one, unless it is known by other middle initials only. Several: the one with this middle initial.
    options = bare.join(owners, ["field", "form"]).withColumn("same", F.coalesce(F.array_contains("middles", F.col("middle")), F.lit(False)))
    options = options.groupBy("field", "name").agg(
        F.count(F.lit(1)).alias("c"), F.min("entity").alias("only"), F.count_if("same").alias("cs"), F.min(F.when(F.col("same"), F.col("entity"))).alias("matched"),
        F.max(F.when(F.col("middle").isNotNull() & ~F.col("same") & (F.size("middles") > 0), 1).otherwise(0)).alias("against"),
    )
    chosen = options.select("field", "name", F.when(F.col("cs") == 1, F.col("matched")).when((F.col("c") == 1) & (F.col("against") == 0), F.col("only")).alias("entity"))
    alone = F.concat(F.lit("i:"), F.col("form"), F.lit("|"), F.coalesce("middle", F.lit("")))
    attached = bare.join(chosen, ["field", "name"], "left").select("field", "name", "n", "kind", F.coalesce("entity", alone).alias("entity"))
    return known.select("field", "name", "n", "kind", "entity").unionByName(attached)


def field_names(metadata: DataFrame, columns: tuple[str, ...] = ("author", "creator", "producer")) -> DataFrame:
    """(field, name, n): distinct non-blank spellings with their rows."""
    each = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("name")) for c in columns))
    rows = metadata.select(F.explode(each).alias("v")).select("v.field", "v.name").where(F.col("name").isNotNull() & F.col("name").rlike(r"\S"))
    return rows.groupBy("field", "name").agg(F.count(F.lit(1)).alias("n"))


def pairs(linked: DataFrame) -> DataFrame:
    """(field, name_a, name_b): all pairs of different spellings of one entity."""
    b = linked.select("field", "entity", F.col("name").alias("name_b"))
    return linked.select("field", "entity", F.col("name").alias("name_a")).join(b, ["field", "entity"]).where("name_a < name_b").select("field", "name_a", "name_b")
