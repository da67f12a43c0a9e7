"""Names of people and organisations: their forms, phonetic codes and comparison."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Short and pet forms of given names that no rule below gives.
NICKNAMES = {
    "abigail": "gail abby abbie", "adelaide": "heidi", "agnes": "nessie", "albert": "bert bertie", "alexander": "alec sandro sandy sasha xander lex", "alexandra": "sandra sandy sasha lexi", "alfred": "fred freddie",
    "alice": "allie", "amelia": "millie emmy", "andrew": "drew", "angela": "angie", "ann": "nan nancy annie", "anthony": "tony ant", "archibald": "archie", "arthur": "art", "augustine": "gus augie austin", "barbara": "babs",
    "barnabas": "barney", "bartholomew": "bat", "beatrice": "bea trixie", "benjamin": "benji benny", "bridget": "biddy bridie", "cameron": "cam", "caroline": "caro carrie lina", "catherine": "cate kate katie kathy kitty kit cathy kath",
    "charles": "chuck chip charlie", "charlotte": "lottie charlie", "christina": "tina chris", "christine": "tina chris", "christopher": "kit topher kris", "clarence": "larry", "cornelius": "neil neels cor corrie", "cynthia": "cindy", "daniel": "dan danny",
    "daniella": "dani danni", "david": "dave", "deborah": "deb debbie", "dennis": "denny", "desmond": "dez des", "dominic": "nick", "donald": "don", "dorothy": "dot dottie dolly", "edmund": "ed ted eddie", "edward": "ed ted teddy ned eddie",
    "edwin": "ed eddie", "eleanor": "nell nellie nora ellie", "elizabeth": "betty betsy bess liz lizzie libby eliza lisa", "ellen": "nell", "emily": "em millie", "emmanuel": "manny", "ernest": "ernie", "eugene": "gene",
    "evelyn": "evie", "florence": "flo flossie", "frances": "fran fanny frankie", "francis": "frank", "franklin": "frank", "frederick": "fred freddie fritz", "gabriella": "gabi gaby", "geoffrey": "jeff", "george": "geordie", "gerald": "gerry jerry",
    "gertrude": "trudy", "gilbert": "gil bert", "gregory": "greg", "harold": "hal harry", "harriet": "hattie harry", "harrison": "harry", "helen": "nell", "henrietta": "hettie etta", "henry": "harry hank hal", "herbert": "herb bert",
    "hubert": "bert", "ignatius": "iggy nate natie ignaz", "isaac": "ike zak", "isabella": "izzy", "jacob": "jake coby", "jacqueline": "jackie jacqui", "james": "jim jimmy jamie", "jane": "janie", "janet": "jan", "jeffrey": "jeff", "jeremiah": "jerry", "jeremy": "jerry",
    "jessica": "jess jessie", "joan": "joanie", "johannes": "hans jan johan hannes", "john": "jack johnny", "jonathan": "jon jonny nathan", "joseph": "joe joey jo", "josephine": "josie jo", "joshua": "josh", "judith": "judy", "katharina": "kat käthe katja",
    "katherine": "kate katie kathy kitty kit", "kenneth": "ken", "lawrence": "larry", "leonard": "len lenny", "leonardo": "leo len lenny", "lillian": "lily", "louise": "lou", "lucille": "lucy", "madeleine": "maddie", "magdalena": "lena maggie", "margaret": "peggy peg meg maggie madge daisy greta rita", "maria": "mia",
    "martha": "patty mattie", "martin": "marty", "mary": "polly molly mamie", "matilda": "tilly mattie", "matthew": "matty", "matthias": "matty", "maximilian": "max", "michael": "mike mick mickey", "mildred": "millie", "miriam": "mimi mitzi", "mohammed": "mo moe", "montgomery": "monty",
    "natalia": "nat natty tasha", "nathaniel": "nate", "nicholas": "nick klaus colin", "nomvula": "nomi", "octavia": "tavy", "oliver": "ollie", "oscar": "ossie", "patricia": "pat patsy patty trish", "patrick": "pat paddy", "penelope": "penny nell", "peter": "pete",
    "philip": "pip phil", "priscilla": "cilla", "prudence": "pru", "rachel": "rae", "raymond": "ray", "rebecca": "becky bex", "reginald": "reggie", "richard": "rick dick ritchie", "robert": "rob bob bobby robin", "roderick": "rod roddy", "roland": "rolly", "ronald": "ron ronnie",
    "rosalind": "roz rose rosa", "rosemary": "rosie", "roxanne": "roxy", "rudolph": "rudy", "russell": "russ", "samantha": "sam sammy", "samuel": "sam sammy", "sarah": "sally sadie", "sebastian": "bastian seb", "sibusiso": "sbu", "sophia": "sophie", "stephen": "steve steven",
    "susan": "sue suzy", "sylvester": "sly", "sylvia": "syl", "terence": "terry", "teresa": "terry tess", "thandeka": "thandi", "theodora": "dora theo thea", "theodore": "ted teddy theo", "theresa": "terry tess", "thomas": "tom tommy", "timothy": "tim", "tobias": "toby", "ursula": "uschi ulla", "valerie": "val",
    "veronica": "ronnie vera", "victoria": "vicky tori", "vincent": "vince vinny", "virginia": "ginny", "walter": "wally walt", "wilfred": "fred", "wilhelmina": "minnie billie willa wilma", "william": "bill billy liam will", "winifred": "freda winnie", "yolanda": "yoli", "zacharias": "zach zack zac",
}
#: Words of an organisation's name that don't tell it apart.
FILLERS = frozenset("the and co cc pty ltd inc llc plc sons bros company limited".split())

FORMAL = {n: frozenset([f for f, ns in NICKNAMES.items() if n in ns.split()]) for ns in NICKNAMES.values() for n in ns.split()}
FORMAL |= {f: frozenset([f]) for f in NICKNAMES}

LETTERS = re.compile(r"[^\W\d_]+")
#: The consonant classes of Soundex.
CLASSES = {c: d for d, cs in {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}.items() for c in cs}


def plain_tokens(text: str) -> list[str]:
    """Lower-case letter runs without accents; apostrophes and hyphens part them."""
    flat = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return LETTERS.findall(flat.lower())


def form(kind: str, tokens: list[str]) -> str | None:
    """The form of a name: its kind and sorted tokens, without fillers, and without middle initials where two words remain.

    None where nothing could tell the name apart: no word of two letters, or a single word without an initial.
    """
    tokens = [t for t in tokens if t not in FILLERS]
    longs, initials = [t for t in tokens if len(t) > 1], [t for t in tokens if len(t) == 1]
    if len(longs) > 1:
        initials = []
    if not longs or len(longs) + len(initials) < 2:
        return None
    return f"{kind}|{' '.join(sorted([*longs, *initials]))}"


def telling(tokens: list[str]) -> list[str]:
    """The words of a form that may tell it apart, by which it is found: those of five letters or more, or else every word."""
    long = [t for t in tokens if len(t) >= 5]
    return long or [t for t in tokens if len(t) > 1]


@lru_cache(maxsize=100_000)
def phonetic(token: str) -> str:
    """Consonant classes in order, repeats without a vowel between them taken once."""
    out, last = [], ""
    for c in token:
        d = CLASSES.get(c, "")
        if d and d != last:
            out.append(d)
        last = d
    return "".join(out)


def phonetic_keys(token: str) -> list[str]:
    """The code and the codes with one class left out: two words one edit apart share one of them."""
    code = phonetic(token)
    return sorted({code, *(code[:i] + code[i + 1 :] for i in range(len(code)))})


def initials_of(token: str) -> set[str]:
    """First letters a given name may be abbreviated to: its own and those of its formal names."""
    return {token[0], *(f[0] for f in FORMAL.get(token, ()))}


@lru_cache(maxsize=100_000)
def beside_keys(kind: str, token: str) -> tuple[list[str], list[str]]:
    """The keys by which a word of two letters or more asks and answers beside the word that tells a name apart.

    Words that ``same_beside`` takes for the same have a key in common: known given names their formal names, others a
    phonetic key, short forms three letters that their name has in a row, a trade and its short form their first letters. By
    these letters only short words meet longer ones.
    """
    same = {f"={f}" for f in FORMAL.get(token, ())} if kind == "name" else set()
    if len(token) >= 4:
        same |= {f"~{k}" for k in phonetic_keys(token)}
    same.add(f"={token}")
    asks, answers = set(same), set(same)
    if kind == "name":
        if 3 <= len(token) <= 6:
            asks.add(f">^{token[:3]}")
            answers.add(f"<^{token[:3]}")
        if len(token) >= 5:
            inner = {token[i : i + 3] for i in range(len(token) - 2)}
            asks |= {f"<^{x}" for x in inner}
            answers |= {f">^{x}" for x in inner}
    else:
        short = len(token) <= 4
        asks |= {f"^{token[:3]}", f">{token[0]}"} | ({f"<{token[0]}"} if short else set())
        answers |= {f"^{token[:3]}", f"<{token[0]}"} | ({f">{token[0]}"} if short else set())
    return sorted(asks), sorted(answers)


@lru_cache(maxsize=100_000)
def initial_keys(kind: str, token: str) -> tuple[list[str], list[str]]:
    """The keys by which a name's initial and the words that it may stand for ask and answer; a letter brings no two full names together."""
    if kind != "name":
        return [], []
    if len(token) == 1:
        return [f"<{token}", f".{token}"], [f">{token}", f".{token}"]
    return sorted(f">{c}" for c in initials_of(token)), sorted(f"<{c}" for c in initials_of(token))


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    used, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    m = len(hits)
    if not m:
        return 0.0
    other = [c for c, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(hits, other)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return jaro + min(4, prefix) * 0.1 * (1 - jaro)


def one_edit(a: str, b: str) -> bool:
    """At most one letter left out, added, replaced, or swapped with its neighbour."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


#: Closeness by Jaro-Winkler from which two words are the same: of four letters, with one slip, with more of them in a long word.
CLOSE_SHORT, CLOSE, CLOSE_LONG, LONG = 0.93, 0.86, 0.93, 8


@lru_cache(maxsize=200_000)
def same_word(a: str, b: str) -> bool:
    """Equal, or close by Jaro-Winkler: the more two words differ, the closer they have to be, and with more than one slip
    they begin and sound alike; words of three letters and fewer must be equal."""
    if a == b:
        return True
    short = min(len(a), len(b))
    if short < 4:
        return False
    if one_edit(a, b):
        return jaro_winkler(a, b) >= (CLOSE_SHORT if short == 4 else CLOSE)
    return short >= LONG and a[0] == b[0] and phonetic(a) == phonetic(b) and jaro_winkler(a, b) >= CLOSE_LONG


def short_stems(a: str) -> set[str]:
    """The beginnings of three letters or more by which a short form stands for a given name: itself, and without y, ie, i or ey after it."""
    stem_ = re.sub("(?<=..)(ie|ey|y|i|e)$", "", a)
    return {x for x in (a, stem_, stem_[:-1] if stem_[-1:] == stem_[-2:-1] else stem_) if len(x) >= 3}


def short_of(a: str, b: str) -> bool:
    """``a`` is a short form of the given name ``b`` by rule: its beginning, also with y, ie, i or ey after it, or four letters or more of its rest."""
    if not 3 <= len(a) <= 6 or len(b) < len(a) + 2:
        return False
    return any(map(b.startswith, short_stems(a))) or len(a) >= 4 and a in b[1:]


def short_keys(a: str) -> list[str]:
    """The keys by which a short form asks for the given names that hold it; ``short_of`` decides."""
    return sorted({f"^{x}" for x in short_stems(a)} | ({f"~{a}"} if len(a) >= 4 else set())) if 3 <= len(a) <= 6 else []


def held_keys(b: str) -> list[str]:
    """The keys by which a given name answers to its short forms by rule."""
    return sorted({f"^{b[:n]}" for n in range(3, 7)} | {f"~{b[i : i + n]}" for n in range(4, 7) for i in range(1, len(b) - n + 1)})


@lru_cache(maxsize=200_000)
def same_given(a: str, b: str) -> bool:
    """The same given name: equal, a nickname of it, or a typing error of it; two known names are never errors of each other.

    A name of the table has the nicknames of the table and those by rule; two names of which one is a nickname of the
    table and the other another full name of it are different.
    """
    x, y = FORMAL.get(a), FORMAL.get(b)
    if x and y:
        return bool(x & y)
    return same_word(a, b) or short_of(a, b) or short_of(b, a)


def abbreviates(a: str, b: str) -> bool:
    """``a`` shortens ``b``: its first three letters or more, or up to four of its letters in order, from the first on."""
    if not 3 <= len(a) < len(b) - 1 or a[0] != b[0]:
        return False
    rest = iter(b)
    return b.startswith(a) or len(a) <= 4 and all(c in rest for c in a)


def same_trade(a: str, b: str) -> bool:
    return same_word(a, b) or abbreviates(a, b) or abbreviates(b, a)


def same_beside(kind: str, a: str, b: str) -> bool:
    """Whether two words beside those that tell names apart mean the same."""
    return same_given(a, b) or same_word(a, b) if kind == "name" else same_trade(a, b)


def _split(form_: str) -> tuple[list[str], list[str]]:
    tokens = form_.partition("|")[2].split(" ")
    return [t for t in tokens if len(t) > 1], [t for t in tokens if len(t) == 1]


def same_name(x: str, y: str) -> bool:
    """Whether two forms of one kind mean the same person or organisation."""
    if x == y:
        return True
    kind = x.partition("|")[0]
    if kind != y.partition("|")[0]:
        return False
    (a, i), (b, j) = _split(x), _split(y)
    if kind == "org":
        if len(a) != len(b) or len(a) < 2 or i or j:
            return False
        return _assign(a, b, lambda p, q: same_word(p, q), lambda p, q: same_trade(p, q))
    if len(a) == len(b) >= 2:
        return _assign(a, b, lambda p, q: same_word(p, q), same_given)
    if len(a) == len(b) == 1:
        return same_word(a[0], b[0]) and bool(set(i) & set(j))
    if len(a) == 1 and len(b) == 2:
        return any(same_word(a[0], b[k]) and b[k] not in FORMAL and set(i) & initials_of(b[1 - k]) for k in (0, 1))
    if len(b) == 1 and len(a) == 2:
        return same_name(y, x)
    return False


def _assign(a: list[str], b: list[str], head, rest) -> bool:
    """Whether one word of each side is the same by ``head`` and the others pair up by ``rest``."""
    for p in range(len(a)):
        for q in range(len(b)):
            if a[p] in telling(a) and b[q] in telling(b) and not (a[p] in FORMAL and len(a) == 2 and a[1 - p] not in FORMAL) and head(a[p], b[q]):
                left, right = a[:p] + a[p + 1 :], b[:q] + b[q + 1 :]
                for t in left:
                    hit = next((u for u in right if rest(t, u)), None)
                    if hit is None:
                        break
                    right.remove(hit)
                else:
                    return True
    return False


def is_partial(form_: str) -> bool:
    """A surname with initials only."""
    return len(_split(form_)[0]) == 1


@lru_cache(maxsize=100_000)
def is_given(token: str) -> bool:
    """A known given name, or one typing error away from one."""
    return token in FORMAL or any(same_word(token, f) for f in FORMAL if f[0] == token[0] or f[0] == token[1:2])


def named_by(window: str, label: str) -> bool:
    """Whether a run of words of a title means the same as a label; next to a surname whose label
    has only an initial, any word would do, so there it has to be a given name."""
    (a, _), (b, _) = _split(window), _split(label)
    if window.startswith("name|") and len(a) == 2 and len(b) == 1:
        a = [t for t in a if not same_word(t, b[0])]
        if not all(map(is_given, a)):
            return False
    return same_name(window, label)


def windows(title: str, most: int = 4) -> list[str]:
    """The forms of all runs of two to ``most`` words of a title that could be a name."""
    tokens, out = [t for t in plain_tokens(title) if t not in FILLERS], set()
    for size in range(2, most + 1):
        for i in range(len(tokens) - size + 1):
            part = tokens[i : i + size]
            longs = sum(len(t) > 1 for t in part)
            # a person's initials stand beside a surname, or as one among the words
            if longs >= 2 and size - longs <= 1 or longs == 1 and size == 2:
                out.add(form("name", part))
            if longs == size:
                out.add(form("org", part))
    return sorted(f for f in out if f)
