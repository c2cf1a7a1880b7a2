"""Problem 1: link the spellings of one person or organisation typed in several ways within a film.

Merge-and-rematch resolution. Every distinct spelling is parsed into a profile: parts (given names, surname, or the words of
an organisation), each with the words and the initials it is known by. Profiles of a film that share a block are scored in
pairs, part by part. Accepted pairs are merged: the parts that fit each other unite their words and initials, so a merged
profile matches what none of its spellings matched by itself. It enters the blocks again with all of its keys, and the rounds
go on until one brings no further merge.

What a pair needs:

* two full names: each part of one fits a part of the other (the same, a nickname, a clipped name, or a slip of the keyboard);
* an incomplete name (one word, or a word with an initial or a cut-off word) fits exactly one best full name of its film;
* an organisation: the same kind of organisation and the same proper part, in any order, written out or abbreviated, or the
  initials of all its words;
* numbered extras and names without letters only equal themselves, apart from case and punctuation.

Relatives are kept apart without a list of their names. A slip of the keyboard differs from time to time, a name recurs: two
words a slip apart that are both used in several films, the rarer not rarer than a 25th of the other, are two names. Where the
films say too little, given names that differ by an ending of gender are two names. Two people whose given names are known
nicknames of different names are two people, too. A spelling that fits two people equally well stays alone.

Null and '' speakers are no names. Scale: the input is first reduced to distinct (film, speaker) with a partial
aggregate, so a serial that holds a third of all rows shrinks to its cast before anything is joined.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

# Titles and organisation words with their abbreviations; given names with their nicknames, common ones of English
# and some of other languages. Nicknames that are only the beginning of the name are left to
# a rule. A parameter: `nicknames` of `resolve_names` takes another table in the same form.
TITLES = """
AGENT; CAPTAIN CAPT CPT; COLONEL COL; CONSTABLE PC; CORPORAL CPL; DETECTIVE DET; DOCTOR DR; FATHER FR; GENERAL GEN;
INSPECTOR INSP; JUDGE; LADY; LIEUTENANT LT LIEUT; LORD; MAJOR MAJ; MISS; MISTER MR; MRS; MS; OFFICER OFC; PRESIDENT PRES;
PROFESSOR PROF; REVEREND REV; SENATOR SEN; SERGEANT SGT; SIR
"""
ORGANISATIONS = """
AGENCY AGCY; ASSOCIATION ASSN ASSOC; BANK; BUREAU BUR; CLUB; COLLEGE COLL; COMMITTEE CTTEE; COMPANY CO; CORPORATION CORP;
COUNCIL; DEPARTMENT DEPT; DISPATCH DISP; FOUNDATION FDN; HOSPITAL HOSP; INCORPORATED INC; INSTITUTE INST; LIMITED LTD;
MINISTRY MIN; RADIO; SCHOOL SCH; SOCIETY SOC; TELEVISION TV; UNIVERSITY UNIV
"""
NICKNAMES = """
AARON RON RONNIE; ABIGAIL ABBY GAIL; ABRAHAM ABE BRAM; ADELAIDE ADDIE HEIDI; AGNES AGGIE NESSIE; ALAN AL; ALBERT AL BERT BERTIE;
ALEJANDRO ALEX JANDRO; ALEXANDER ALEX SANDY SASHA LEX XANDER; ALEXANDRA ALEX SANDRA LEXI SASHA; ALFRED AL ALF ALFIE FRED; ALICE ALLIE;
AMANDA MANDY; AMELIA AMY MILLIE; ANASTASIA ANA STACY NASTYA; ANDRE DEDE; ANDREA ANDIE DREA; ANDREW ANDY DREW; ANGELA ANGIE; ANNA ANNIE NAN NANCY;
ANTHONY TONY ANT; ANTONIO TONI TONIO TOÑO; ARCHIBALD ARCHIE; ARTHUR ART ARTIE; AUGUSTUS GUS AUGIE; BARBARA BARB BABS BARBIE; BARTHOLOMEW BART;
BEATRICE BEA TRIXIE; BENJAMIN BEN BENNY BENJI; BERNARD BERNIE; BRIDGET BIDDY BRIDIE; CAROLINE CARRIE CARO;
CATHERINE CATHY CATE KATE KATIE KIT; CECILIA CISSY CECE; CHARLES CHARLIE CHUCK CHAS CHAZ; CHARLOTTE LOTTIE CHARLIE; CHRISTINA TINA CHRISSIE CHRIS;
CHRISTOPHER CHRIS KIT TOPHER; CLARENCE CLARRY; CONSTANCE CONNIE; CORNELIUS CON NEIL; CYNTHIA CINDY; DANIEL DAN DANNY;
DANIELLE DANI ELLE; DAVID DAVE DAVEY; DEBORAH DEB DEBBIE; DENNIS DEN DENNY; DMITRI DIMA MITYA; DOLORES LOLA LOLITA; DOMINIC DOM NICK; DONALD DON DONNIE;
DOROTHY DOT DOLLY DOTTIE DORA; EDMUND ED NED TED; EDWARD ED EDDIE NED TED TEDDY; EDWIN ED EDDIE WIN; ELEANOR ELLIE NELL NORA;
ELENA LENOCHKA NELYA; HELENA LENA; MAGDALENA LENA MAGDA; ELIZABETH LIZ BETH BETTY LIZZIE ELIZA BESS LIBBY; EMILY EM MILLY; EMMANUEL MANNY; ERIC RICK; ERNEST ERNIE; EUGENE GENE; EVELYN EVIE;
EZEKIEL ZEKE; FLORENCE FLO FLOSSIE; FRANCES FRAN FANNY FRANKIE; FRANCIS FRANK FRANKIE; FRANCISCO PACO PANCHO FRAN KIKO; FREDERICK FRED FREDDIE FRITZ;
GABRIEL GABE; GABRIELLE GABBY ELLE; GEOFFREY GEOFF JEFF; GEORGE GEORDIE; GERALD GERRY JERRY; GERTRUDE GERTIE TRUDY; GILBERT GIL BERT;
GIOVANNI GIANNI NINO VANNI; GIUSEPPE BEPPE PEPPE PEPPINO; GREGORY GREG; GUILLERMO MEMO; HARRIET HATTIE; HAROLD HAL HARRY;
HELEN NELL NELLIE; HENRIETTA HETTIE ETTA; HENRY HARRY HANK HAL; HERBERT HERB BERT; HOWARD HOWIE; IGNACIO NACHO; ISAAC IKE ZAC; ISABELLA BELLA IZZY BELLE;
JACOB JAKE; JACQUELINE JACKIE; JAMES JIM JIMMY JAMIE; JANET JAN; JEAN JEANNIE; JENNIFER JEN JENNY; JEREMIAH JERRY; JESSICA JESS JESSIE;
JESUS CHUY; JOAN JOANIE; JOANNA JO; JOHANNES HANS HANNES; JOHN JACK JOHNNY; JONATHAN JON JONNY; JOSE PEPE; JOSEPH JOE JOEY; JOSEPHINE JO JOSIE;
JOSHUA JOSH; JUDITH JUDY; JULIA JULIE; KATHERINE KATE KATHY KIT KATIE KAY; KENNETH KEN KENNY; LAURA LAURIE; LAWRENCE LARRY LAURIE; LEONARD LEN LENNY LEO;
LEOPOLD LEO POLDI; LESLIE LES; LILLIAN LIL LILY; LOUIS LOU LOUIE; LOUISE LOU LULU; LUCILLE LUCY; MADELEINE MADDIE; MARGARET MAGGIE MEG PEGGY MARGE MARGIE;
MARIA MARIE MIA; MARTHA MARTY MATTIE; MARTIN MARTY; MARY MOLLY POLLY; MATILDA TILLY MATTIE; MATTHEW MATT; MAURICE MO MORRIE; 
MELISSA MEL LISSA; MICHAEL MIKE MICK MIKEY MICKEY; MIKHAIL MISHA; MILDRED MILLIE; MONTGOMERY MONTY; NATHANIEL NAT NATE; NICHOLAS NICK NICKY NICO;
NIKOLAI KOLYA; OLENA LENA OLYA; OLIVER OLLIE; OLIVIA LIV LIVVY; OSCAR OZZIE; PATRICIA PAT TRISH PATTY TRICIA; PATRICK PAT PADDY;
PENELOPE PENNY; PERCIVAL PERCY; PETER PETE; PHILIP PHIL PIP; PHILIPPA PIPPA; RACHEL RAE; RAYMOND RAY; REBECCA BECKY BECCA; REGINALD REG REGGIE;
RICHARD RICK RICHIE DICK RICH RICKY; ROBERT BOB BOBBY ROB ROBBIE BERT; RODERICK ROD RORY; ROGER ROD; RONALD RON RONNIE; ROSEMARY ROSE ROSIE;
RUDOLPH RUDI; RUPERT BERT; SALVADOR SAL CHAVA; SAMANTHA SAM SAMMY; SAMUEL SAM SAMMY; SARAH SALLY SADIE; SEBASTIAN SEB BASTIAN; SERGEI SERYOZHA;
STEPHANIE STEPH STEFFI; STEPHEN STEVE STEVIE; STEVEN STEVE STEVIE; SUSAN SUE SUSIE SUZY;
SUSANNAH SUE SUSIE SANNA; TERENCE TERRY; THEODORE TED TEDDY THEO; THERESA TERRY TESS; THOMAS TOM TOMMY; TIMOTHY TIM TIMMY; TOBIAS TOBY; 
VERONICA RONNIE VERA; VICTOR VIC; VICTORIA VICKY TORI VIC; VINCENT VINCE VINNIE; VIRGINIA GINNY; VLADIMIR VOVA VOLODYA; WALTER WALT WALLY;
WILFRED WILF FRED; WILHELMINA MINA MINNIE; WILLIAM WILL BILL BILLY WILLIE LIAM; WINIFRED WINNIE FREDDIE; YEVGENY ZHENYA; ZACHARY ZACH ZACK
"""
SMALL_WORDS = {"THE", "OF", "AND", "FOR", "DE", "LA"}

# Endings that make a given name one of the other gender.
GENDERED = ("A", "E", "IE", "INE", "INA", "ETTE", "ETTA", "ELLE", "LE", "NE", "TTE")

TYPO_LEN = 4
"""Words shorter than this are never taken for a slip of another."""


def fold(s: str) -> str:
    """Upper case without accents, with plain apostrophes."""
    s = unicodedata.normalize("NFKD", s.replace("’", "'"))
    return "".join(c for c in s if not unicodedata.combining(c)).upper()


def _lines(text: str) -> dict[str, str]:
    return {w: e.split()[0] for e in fold(text).split(";") for w in e.split()}


_TITLE, _ORG = _lines(TITLES), _lines(ORGANISATIONS)


def formal_names(table: str) -> dict[str, frozenset[str]]:
    """Word -> the formal names it may stand for, itself among them if it is one."""
    out: dict[str, frozenset[str]] = {}
    for entry in fold(table).split(";"):
        own = entry.split()
        for w in own:
            out[w] = out.get(w, frozenset()) | {own[0]}
    return out


FORMAL = formal_names(NICKNAMES)


@lru_cache(1 << 16)
def slip(a: str, b: str) -> bool:
    """One letter added, dropped, replaced, or two neighbours swapped."""
    if min(len(a), len(b)) < TYPO_LEN or abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    if len(a) < len(b):
        a, b = b, a
    return a[i + 1 :] == b[i:]


@lru_cache(1 << 16)
def _organisation(word: str) -> str | None:
    """The kind of organisation that a word, an abbreviation or a slip of a long one stands for."""
    return _ORG.get(word) or (next((o for w, o in _ORG.items() if len(w) > 6 and slip(w, word)), None) if len(word) > 5 else None)


def parse(speaker: str) -> dict:
    """Kind (person, org, other), parts (word, whether it is whole), title, initials of an organisation, and the key under which
    equal names meet."""
    text = re.sub(r"\([^)]*\)?", " ", fold(speaker))
    if "," in text:
        last, _, first = text.partition(",")
        text = f"{first} {last}"
    raw = [t for t in re.split(r"[\s\-_/]+", text) if re.search(r"\w", t)]
    if not raw:
        return {"k": "other", "p": [], "eq": "raw:" + speaker}
    bare = [re.sub(r"[^\w']", "", t) for t in raw]
    if any(b.isdigit() for b in bare):
        return {"k": "other", "p": [], "eq": "n:" + " ".join(bare)}

    kinds = [_organisation(b) for b in bare]
    core = [b for b, k in zip(bare, kinds) if not k and b not in SMALL_WORDS]
    if any(kinds) and core:
        kind = next(k for k in reversed(kinds) if k)
        letters = "".join((k or b)[0] for b, k in zip(bare, kinds) if b not in SMALL_WORDS)
        return {"k": "org", "o": kind, "p": [(b, True) for b in core], "i": letters if len(letters) > 2 else "", "eq": f"o:{kind}:" + " ".join(sorted(core))}
    title, parts = "", []
    for t, b in zip(raw, bare):
        if b in _TITLE and len(raw) > 1 and not (len(b) < 4 and not t.endswith(".")):
            title = _TITLE[b]
        else:
            parts.append((b, len(b) > 1 and not (t.endswith(".") and len(b) < 5)))
    if not parts:
        return {"k": "other", "p": [], "eq": "n:" + " ".join(bare)}
    words, cuts = sorted(b for b, w in parts if w), sorted(b for b, w in parts if not w)
    return {"k": "person", "t": title, "p": parts, "eq": "p:" + " ".join(words) + "|" + " ".join(cuts)}


def profile(parsed: dict, films: dict[str, int]) -> dict:
    """A spelling as a profile: kind, organisation, initials, and for each part its words (with the films that use them) and
    its initials and cut-off words."""
    return {"k": parsed["k"], "o": parsed.get("o", ""), "i": parsed.get("i", ""), "p": [[{b: films.get(b, 1)}, []] if whole else [{}, [b]] for b, whole in parsed["p"]]}


def gendered(short: str, long: str) -> bool:
    """Whether a name is another one with an ending of gender; a single letter only after a consonant, or an a after e."""
    end = long[len(short) :]
    return long.startswith(short) and end in GENDERED and (len(end) > 1 or short[-1] not in "AEIOUY" or (short[-1], end) == ("E", "A"))


def two_names(a: str, n_a: int, b: str, n_b: int, given: bool) -> bool:
    """Whether two words a slip apart are names of their own, by how many films use each."""
    if any(c.isdigit() for c in a + b):
        return False
    low, high = min(n_a, n_b), max(n_a, n_b)
    if low >= 3 and low * 25 >= high:
        return True
    if high >= 40 or not given:
        return False
    short, long = sorted((a, b), key=len)
    if len(short) == len(long):
        return a[:-1] == b[:-1] and {a[-1], b[-1]} in ({"A", "O"}, {"A", "E"})
    return gendered(short, long)


def _clipped(a: str, b: str) -> bool:
    """Whether the shorter is the beginning of the longer as a nickname is, with or without -y: not by an ending of gender."""
    short, long = sorted((a, b), key=len)
    stem = re.sub(r"(.)\1$", r"\1", re.sub(r"(?:IE|Y)$", "", short))
    for x in {short, stem}:
        if 3 <= len(x) <= 5 and long.startswith(x) and len(long) >= len(x) + 3 and long[len(x) :] not in GENDERED:
            return True
    return False


def _word(a: str, n_a: int, b: str, n_b: int, given: bool, formal: dict = FORMAL) -> float:
    if a == b:
        return 3.0
    fa, fb = formal.get(a), formal.get(b)
    if fa and fb:
        return 2.5 if fa & fb else 0.0
    if slip(a, b):
        return 0.0 if two_names(a, n_a, b, n_b, given) else SLIP
    return 2.25 if given and _clipped(a, b) else 0.0


SLIP = 2.0


def _cut(c: str, b: str, formal: dict) -> float:
    """A cut-off word or initial against a word."""
    return 1.5 if b.startswith(c) else 1.0 if any(f.startswith(c) for f in formal.get(b, ())) else 0.0


def _fit(x: list, y: list, given: bool, formal: dict) -> float:
    """How well two parts fit. Initials only speak where one of the parts has no word."""
    if x[0] and y[0]:
        return max(_word(a, n, b, m, given, formal) for a, n in x[0].items() for b, m in y[0].items())
    if x[0] or y[0]:
        words, cuts = (x[0], y[1]) if x[0] else (y[0], x[1])
        return max(_cut(c, w, formal) for w in words for c in cuts)
    return max(1.0 if a.startswith(b) or b.startswith(a) else 0.0 for a in x[1] for b in y[1])


def _assign(gain: list[list[float]]) -> list[int]:
    """The column of each row in the assignment of the largest sum; no more rows than columns (shortest augmenting paths)."""
    n, m = len(gain), len(gain[0])
    u, v, match, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, seen = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            seen[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not seen[j]:
                    cost = -gain[i0 - 1][j - 1] - u[i0] - v[j]
                    if cost < least[j]:
                        least[j], way[j] = cost, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if seen[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def lay(a: list, b: list, formal: dict = FORMAL, named: bool = True) -> tuple[float, list[int]]:
    """(score, places in `b`) of the parts of `a`, which has no more parts than `b`; score 0 if one has no place.

    At least one part must fit by a whole word. One slip is allowed, a second one only in another part of a name of two parts
    or more, both in words of five letters or more.
    """
    if not a:
        return 0.0, []
    last_a, last_b = len(a) - 1 if len(a) > 1 else -1, len(b) - 1 if len(b) > 1 else -1
    fits = [[_fit(x, y, named and i != last_a and j != last_b, formal) for j, y in enumerate(b)] for i, x in enumerate(a)]
    # a part without a place weighs more than any slips, a slip more than anything else
    gain = [[-1e6 if f == 0.0 else f - 1e3 * (f == SLIP) for f in row] for row in fits]
    if len(b) <= 3:
        best = max(permutations(range(len(b)), len(a)), key=lambda p: (sum(gain[i][j] for i, j in enumerate(p)), [-j for j in p]))
    else:
        best = _assign(gain)
    got = [fits[i][j] for i, j in enumerate(best)]
    slips = [min(len(w) for part in (a[i], b[j]) for w in part[0]) for i, j in enumerate(best) if fits[i][j] == SLIP]
    if min(got) == 0.0 or max(got) < SLIP or len(slips) > 2 or len(slips) == 2 and min(slips) < 5:
        return 0.0, []
    return sum(got) - 0.5 * max(0, len(slips) - 1), list(best)


def _match(a: dict, b: dict, formal: dict) -> tuple[float, list[int], bool]:
    """(score, places, whether `a` was laid on `b`) of two profiles."""
    if a["k"] == "other" or b["k"] == "other":
        return 0.0, [], True
    if a["k"] != b["k"]:
        org, one = (a, b) if a["k"] == "org" else (b, a)
        words = [next(iter(p[0]), "") for p in one["p"]]
        if len(words) == 1 and words[0] and words[0] == org["i"] and words[0] not in formal:
            return 2.0, [], True
        same = len(one["p"]) == len(org["p"]) and all(set(x[0]) & set(y[0]) for x, y in zip(one["p"], org["p"]))
        return (3.0 if same else 0.0), [], True
    if a["k"] == "org" and (a["o"] != b["o"] or len(a["p"]) != len(b["p"])):
        return 0.0, [], True
    if a["k"] == "person":
        whole = [sum(bool(p[0]) for p in x["p"]) for x in (a, b)]
        if len(a["p"]) != len(b["p"]) and min(len(a["p"]), len(b["p"])) > 1 and min(whole) < 2:
            return 0.0, [], True
    swap = len(a["p"]) > len(b["p"])
    score, at = lay(*((b["p"], a["p"]) if swap else (a["p"], b["p"])), formal, a["k"] == "person")
    return score, at, not swap


def apart(a: dict, b: dict, formal: dict = FORMAL) -> bool:
    """Whether two full names of one surname are known to be two people: given names that stand for different formal names, that
    recur both, or that differ by an ending of gender."""
    x, y = a["p"], b["p"]
    if a["k"] != "person" or b["k"] != "person" or min(len(x), len(y)) < 2 or not (x[0][0] and y[0][0] and x[-1][0] and y[-1][0]):
        return False
    if x[0][0].keys() & y[0][0].keys() or _fit(x[-1], y[-1], False, formal) < SLIP:
        return False
    for v, n in x[0][0].items():
        for w, m in y[0][0].items():
            fv, fw = formal.get(v), formal.get(w)
            short, long = sorted((v, w), key=len)
            if fv and fw:
                if not fv & fw:
                    return True
            elif max(n, m) < 40 and gendered(short, long) or slip(v, w) and two_names(v, n, w, m, True):
                return True
    return False


def profile_score(a: list[dict], b: list[dict], formal: dict = FORMAL) -> float:
    """How well two entities fit, each a list of profiles; 0 means not at all, -1 that they are known to be two people."""
    return max(_match(x, y, formal)[0] for x in a for y in b) or (-1.0 if any(apart(x, y, formal) for x in a for y in b) else 0.0)


def pair_score(a: dict, b: dict) -> float:
    """How well two parsed spellings fit; 0 means not at all."""
    return max(0.0, profile_score([profile(a, {})], [profile(b, {})]))


def unite(profiles: list[dict], formal: dict = FORMAL) -> list[dict]:
    """The union of the profiles of one entity: parts that fit each other unite their words and initials. A profile that fits none of
    the others by itself (it was linked through a third) stays beside them."""
    order = sorted(profiles, key=lambda p: (-sum(bool(x[0]) for x in p["p"]), -len(p["p"]), json.dumps(p, sort_keys=True)))
    out: list[dict] = []
    for p in order:
        for k, held in enumerate(out):
            score, at, onto = _match(p, held, formal)
            if score and held["k"] == p["k"] and p["k"] != "other":
                small, large = (p, held) if onto else (held, p)
                parts = [[dict(w), list(c)] for w, c in large["p"]]
                for (w, c), j in zip(small["p"], at):
                    parts[j][0] = {x: max(w.get(x, 0), parts[j][0].get(x, 0)) for x in sorted(w.keys() | parts[j][0].keys())}
                    parts[j][1] = sorted({*parts[j][1], *c})
                out[k] = held | {"p": parts, "i": held["i"] or p["i"]}
                break
            if p == held:
                break
        else:
            out.append(p)
    return out


def is_full(p: dict) -> bool:
    """Whether the profile names someone by itself."""
    return p["k"] == "org" or p["k"] == "person" and sum(bool(x[0]) for x in p["p"]) >= 2


def block_keys(p: dict, formal: dict = FORMAL) -> list[str]:
    """Blocks of a profile: words, formal names, first and last three letters, all letters in order of the alphabet, and the initials
    of all parts.

    Two words a slip apart share a block. From 6 letters a slip leaves the first or last three letters, or all letters if
    two are swapped; words of 4 and 5 letters also get the word less each of its letters. Clipped names share their first
    three letters; names of initials alone share all initials.
    """
    keys: set[str] = set()
    for words, _ in p["p"]:
        for w in words:
            keys.add("w:" + w)
            keys.update("w:" + f for f in formal.get(w, ()))
            if len(w) > 2:
                keys.add("a:" + w[:3])
            if len(w) > 4:
                keys.add("z:" + w[-3:])
                keys.add("s:" + "".join(sorted(w)))
            if TYPO_LEN <= len(w) < 6:
                keys.add("d:" + w)
                keys.update("d:" + w[:i] + w[i + 1 :] for i in range(len(w)))
    if p["k"] == "person" and len(p["p"]) > 1:
        keys.update("i:" + "".join(sorted(c)) for c in _initials(p["p"], formal))
    if p["i"]:
        keys.add("w:" + p["i"])
    return sorted(keys)


def _initials(parts: list, formal: dict) -> list[str]:
    """All strings of one initial for each part, by words, formal names and initials. As many as the product of the parts' different
    initials: one for most names."""
    out = [""]
    for words, cuts in parts:
        own = sorted({x[0] for x in (*words, *cuts)} | {f[0] for w in words for f in formal.get(w, ())})
        out = [x + c for x in out for c in own]
    return out


PARSED = "film string, speaker string, eq string, form string, words array<string>, formals array<string>, title string"
UNITED = "film string, ent string, spellings array<string>, profiles string, is_full boolean, keys array<string>, formals array<string>, titles array<string>"


def _parser(formal: dict):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for film, speaker in zip(pdf["film"], pdf["speaker"]):
                p = parse(speaker)
                words = sorted({b for b, whole in p["p"] if whole})
                given = sorted({f for w in words for f in formal.get(w, ())}) if p["k"] == "person" else []
                rows.append((film, speaker, p["eq"], json.dumps({k: v for k, v in p.items() if k != "eq"}), words, given, p.get("t", "")))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])

    return run


def _uniter(formal: dict):  # noqa: ANN202
    """Rows of (film, ent, spellings, lists of profiles, formals, titles) as entities with one united list of profiles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for film, ent, spellings, profiles, formals, titles in zip(pdf["film"], pdf["ent"], pdf["spellings"], pdf["profiles"], pdf["formals"], pdf["titles"]):
                own = [p for x in sorted(profiles) for p in json.loads(x)]
                own = unite(own, formal) if len(own) > 1 else own
                keys = sorted({k for p in own for k in block_keys(p, formal)})
                rows.append((film, ent, list(spellings), json.dumps(own, sort_keys=True), any(map(is_full, own)), keys, list(formals), list(titles)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in UNITED.split(", ")])

    return run


_SCORED = "film string, y string, x string, full_x boolean, formals_x array<string>, titles_x array<string>, full_y boolean, formals_y array<string>, titles_y array<string>, raw double"


def _scorer(formal: dict):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load = lru_cache(1 << 15)(json.loads)
        score = lru_cache(1 << 16)(lambda a, b: profile_score(load(a), load(b), formal))
        for pdf in batches:
            out = pdf.drop(columns=["fx", "fy"])
            out["raw"] = [score(x, y) for x, y in zip(pdf["fx"], pdf["fy"])]
            yield out

    return run


def _scores(entities: DataFrame, old: DataFrame | None, formal: dict) -> DataFrame:
    """The score of every pair of a film that shares a block, as rows of _SCORED. Only pairs with an entity that is `fresh` are scored;
    the others keep the score of the round before."""
    own = entities.select("film", "ent", "fresh", F.explode("keys").alias("key"))
    x = own.select("film", "key", F.col("ent").alias("x"), F.col("fresh").alias("fresh_x"))
    y = own.select("film", "key", F.col("ent").alias("y"), F.col("fresh").alias("fresh_y"))
    pairs = x.join(y, ["film", "key"]).where("x < y and (fresh_x or fresh_y)").select("film", "x", "y").distinct()
    side = lambda n: entities.select("film", F.col("ent").alias(n), F.col("profiles").alias("f" + n), F.col("is_full").alias("full_" + n), F.col("formals").alias("formals_" + n), F.col("titles").alias("titles_" + n))
    new = pairs.join(side("x"), ["film", "x"]).join(side("y"), ["film", "y"]).mapInPandas(_scorer(formal), _SCORED).where("raw <> 0")
    if old is None:
        return new
    steady = entities.where("not fresh").select("film", "ent")
    kept = old.join(steady.withColumnRenamed("ent", "x"), ["film", "x"], "left_semi").join(steady.withColumnRenamed("ent", "y"), ["film", "y"], "left_semi")
    return new.unionByName(kept)


def _links(scored: DataFrame) -> DataFrame:
    """Accepted links (film, x, y) of one round."""
    apart_pairs = scored.where("raw < 0").select("film", F.col("x").alias("y1"), F.col("y").alias("y2"))
    scored = scored.where("raw > 0").withColumn("score", F.round("raw", 3) + F.when(F.arrays_overlap("titles_x", "titles_y"), 0.5).otherwise(0.0)).drop("raw")
    # an initial that one of them took over must not link two people whose given names are known and differ
    named = F.col("full_x") & F.col("full_y") & (F.size("formals_x") > 0) & (F.size("formals_y") > 0)
    scored = scored.where(~named | F.arrays_overlap("formals_x", "formals_y"))
    # each link as seen from either end
    seen = scored.select(
        "film",
        F.explode(
            F.array(
                F.struct(F.col("x").alias("me"), F.col("y").alias("other"), F.col("full_x").alias("full"), F.col("full_y").alias("other_full"), F.col("formals_y").alias("formals"), "score"),
                F.struct(F.col("y").alias("me"), F.col("x").alias("other"), F.col("full_y").alias("full"), F.col("full_x").alias("other_full"), F.col("formals_x").alias("formals"), "score"),
            )
        ).alias("e"),
    ).select("film", "e.*")
    me = W.partitionBy("film", "me")
    seen = seen.withColumn("top", F.coalesce(F.max(F.when(F.col("other_full"), F.col("score"))).over(me), F.max("score").over(me))).withColumn("n_full", F.count(F.when(F.col("other_full"), 1)).over(me))
    best = seen.where((F.col("full") | (F.col("score") == F.col("top"))) & (F.col("full") | F.col("other_full") | (F.col("n_full") == 0)))
    # an incomplete name needs one best partner; a full one partners whose given names agree
    named = F.when(F.col("full") & F.col("other_full") & (F.size("formals") > 0), F.col("formals"))
    best = best.withColumn("n_best", F.count("*").over(me)).withColumn("given", F.collect_set(named).over(me))
    shared = F.aggregate("given", F.get("given", F.lit(0)), lambda a, g: F.array_intersect(a, g))
    ok = best.where((F.col("full") & (~F.col("other_full") | (F.size("formals") == 0) | (F.size(shared) > 0))) | (~F.col("full") & (F.col("n_best") == 1)))
    # of two partners known to be two people only the better one counts, of equal ones none
    first, second = (ok.select("film", "me", F.col("other").alias(f"y{k}"), F.col("score").alias(f"s{k}")) for k in (1, 2))
    torn = apart_pairs.join(first, ["film", "y1"]).join(second, ["film", "me", "y2"])
    torn = torn.select("film", "me", F.explode(F.array(F.when(F.col("s1") <= F.col("s2"), F.col("y1")), F.when(F.col("s2") <= F.col("s1"), F.col("y2")))).alias("other")).where("other is not null").distinct()
    ok = ok.join(torn, ["film", "me", "other"], "left_anti")
    ends = ok.select("film", F.least("me", "other").alias("x"), F.greatest("me", "other").alias("y"))
    return ends.groupBy("film", "x", "y").count().where("count = 2").select("film", "x", "y")


def _merge(rows: DataFrame, key: str, formal: dict) -> DataFrame:
    """Union of the profiles with the same `key` in a film; the least member names the entity."""
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    groups = rows.groupBy("film", key).agg(F.min("ent").alias("ent"), flat("spellings"), F.collect_list("profiles").alias("profiles"), flat("formals"), flat("titles")).drop(key)
    return groups.select("film", "ent", "spellings", "profiles", "formals", "titles").mapInPandas(_uniter(formal), UNITED)


def _single(parsed: DataFrame) -> DataFrame:
    """Each spelling as an entity of one profile, its words with the number of films that use them."""
    words = parsed.select("film", "speaker", F.explode("words").alias("w"))
    films = words.select("film", "w").distinct().groupBy("w").agg(F.count("*").alias("n")).where("n > 1")
    known = words.join(films, "w").groupBy("film", "speaker").agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("known"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [json.dumps([profile(json.loads(f), dict(k) if k is not None else {})], sort_keys=True) for f, k in zip(pdf["form"], pdf["known"])]
            yield pd.DataFrame({"film": pdf["film"], "ent": pdf["speaker"], "eq": pdf["eq"], "profiles": made, "formals": pdf["formals"], "title": pdf["title"]})

    rows = parsed.join(known, ["film", "speaker"], "left").select("film", "speaker", "eq", "form", "known", "formals", "title")
    rows = rows.mapInPandas(run, "film string, ent string, eq string, profiles string, formals array<string>, title string")
    titles = F.when(F.col("title") != "", F.array("title")).otherwise(F.array().cast("array<string>"))
    return rows.select("film", "eq", "ent", F.array("ent").alias("spellings"), "profiles", "formals", titles.alias("titles"))


def resolve_names(units: DataFrame, film: str, speaker: str, nicknames: str = NICKNAMES) -> DataFrame:
    """(film, speaker, entity, n_spellings): one row for each different spelling of a film.

    `entity` is the least spelling of the group. Nulls and '' are left out; so are rows whose film is null, as names of
    unknown films can't be compared. An empty input gives no rows. Each round merges at least one pair, so the rounds end by
    themselves, with the first that merges none; there is no bound on them, on the parts of a name or on its length.
    """
    formal = FORMAL if nicknames is NICKNAMES else formal_names(nicknames)
    names = units.select(F.col(film).alias("film"), F.col(speaker).alias("speaker")).where("film is not null and speaker <> ''").groupBy("film", "speaker").agg(F.count("*").alias("n")).select("film", "speaker")
    parsed = cut(names.mapInPandas(_parser(formal), PARSED))
    entities, settled, scored = cut(_merge(_single(parsed), "eq", formal).withColumn("fresh", F.lit(True))), None, None
    while True:
        scored = cut(_scores(entities, scored, formal))
        links = cut(_links(scored))
        if links.isEmpty():
            break
        # a film without a merge can't change any more; in the others merged profiles enter their blocks again
        films = links.select("film").distinct()
        done = entities.join(films, "film", "left_anti")
        settled = done if settled is None else settled.unionByName(done)
        # each entity joins the least partner it is linked to, or that one's, or the next one's; longer chains close in the next rounds
        step = links.groupBy("film", F.col("y").alias("ent")).agg(F.min("x").alias("to"))
        hop = lambda t: t.join(step.select("film", F.col("ent").alias("to"), F.col("to").alias("next")), ["film", "to"], "left").select("film", "ent", F.coalesce("next", "to").alias("to"))
        to = cut(hop(hop(step)))
        moved = to.unionByName(to.select("film", F.col("to").alias("ent"), "to").distinct().join(to.select("film", "ent"), ["film", "ent"], "left_anti"))
        merged = _merge(entities.join(moved, ["film", "ent"]), "to", formal).withColumn("fresh", F.lit(True))
        still = entities.join(films, "film", "left_semi").join(moved, ["film", "ent"], "left_anti").withColumn("fresh", F.lit(False))
        entities = cut(merged.unionByName(still.select(merged.columns)))
    entities = entities if settled is None else entities.unionByName(settled.select(entities.columns))
    return entities.select("film", F.explode("spellings").alias("speaker"), F.col("ent").alias("entity"), F.size("spellings").alias("n_spellings"))


def linked_pairs(resolved: DataFrame) -> DataFrame:
    """All pairs of spellings of one entity, the lesser by code point first."""
    a = resolved.where("n_spellings > 1").select("film", "entity", F.col("speaker").alias("speaker_a"))
    b = resolved.where("n_spellings > 1").select("film", "entity", F.col("speaker").alias("speaker_b"))
    return a.join(b, ["film", "entity"]).where("speaker_a < speaker_b").select("film", "speaker_a", "speaker_b")
