"""Labelled examples of personal data and of what looks like it, made by rule from a seed.

What is planted is known, so labels don't come from the patterns or features that judge it. Each example
is a text with one planted thing: personal data of a kind in one of its written forms, with or without a
cue before it, or a number, address or setting that isn't personal. Forms are fixed, digits and names are
drawn at random. There are as many examples as asked for, whatever the corpus.
"""

from __future__ import annotations

import random

NAMES = ("john", "jane", "maria", "li", "anna", "peter", "omar", "sofia", "info", "sales", "k.meyer", "j_smith", "ana-lu", "r2", "first.last")
HOSTS = ("example.com", "mail.example.org", "site.org", "firm.de", "uni-x.edu", "post.example.co", "shop.fr", "my-host.net")
CUES = ("call", "tel", "phone", "phone:", "mobile", "fax:", "mail", "contact", "card", "visa card", "server", "host", "my number is", "reach me at", "or", "and", "see", "at", "is", "to", "by", "with", "")
FILLER = ("the old house by the river", "we met again", "sent today", "as noted above", "in the report", "for details", "und so weiter", "dans la ville", "por la tarde", "of the year", "it was late")
#: Forms of personal data: # is a digit, ~ the digit that makes the number pass Luhn, @N a name, @H a host, $N of a setting's value.
PHONES = ("###-###-####", "(###) ###-####", "###.###.####", "### ### ####", "0### ### ####", "(0##) #### ####", "1-###-###-####", "0## ## ## ## ##", "0##-#######")
MAILS = ("@N [at] @H", "@N (at) @H", "@N[at]@H", "@N(at)@H", "@N @ @H", "@N @@H")
CARDS = ("4### #### #### ###~", "51## #### #### ###~", "55##-####-####-###~", "4###-####-####-###~", "4##############~", "53#############~", "34## ###### ####~", "37#############~", "6011 #### #### ###~")
SETTINGS = ("token", "secret", "password", "passwd", "api_key", "api-key", "Token", "PASSWORD", "apikey", "API_KEY")
JOINS = (" = ", "=", ": ", ":", ' = "', "='", ': "')
#: Forms of what isn't: dates, ranges, amounts, numbers of orders, books, versions, places, series.
NUMBERS = (
    "####-##-##", "20##-0#-1#", "19## - 20##", "19##-19##", "1#.0#.20##", "0#-1#-20##", "# ### ###", "## ### ###", "#.###.###", "##.###.###.###", "978-#-##-######-#", "20##0#1#-#######", "#.##.###", "1#.#.#-##.#",
    "##.#### 1#.####", "## ## ## ## ##", "# # # # # # # #", "20## 20## 20##", "1 2 3 4 5 6 7 8 9 10", "17########", "#### #### ####", "#### #### #### ####", "################", "#-######-##-#", "#### - ####", "######-######", "##-##-##-##", "####.####.####", "00##########", "(19##) ###", "(###) 20##",
    "#### #### #### #### ####", "###########", "########", "##########", "### ### ###", "###-##-####-#",
)
NOT_MAILS = ("look (at) this", "meet [at] noon", "@N (at) home", "two @ 5", "@N@home", "be [at] the", "x @ y", "@N [at] work", "look @ it", "(at) last", "read [at] 10.30", "pay @ 2.50", "up (at) 6.15")
WORDS = ("required", "identifier", "documentation", "ingredients", "optional_value", "unknown-user", "description", "management", "see-below", "not_available", "abcdefghij", "placeholder", "undefined", "configuration", "authentication-service", "internationalization", "your_password_here")


def luhn_digit(digits: str) -> str:
    total = sum(int(c) if k % 2 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits)))
    return str(-total % 10)


def filled(form: str, r: random.Random) -> str:
    out = ""
    for part in form.replace("@N", "\0").replace("@H", "\1"):
        if part == "#":
            out += r.choice("0123456789")
        elif part == "~":
            out += luhn_digit("".join(c for c in out if c.isdigit()))
        else:
            out += r.choice(NAMES) if part == "\0" else r.choice(HOSTS) if part == "\1" else part
    return out


def key(r: random.Random) -> str:
    """A value as keys have it: at random from one alphabet, with letters and digits."""
    letters = r.choice(("0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHJKLMNPQRSTUVWXYZ23456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"))
    while True:
        value = "".join(r.choice(letters) for _ in range(r.choice((12, 16, 20, 24, 32, 40, 40, 64, 128))))
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            return value


def made(n: int, seed: int = 41) -> list[dict]:
    """n examples: text, start and end (code points) of what was planted, kind, and personal (true or false)."""
    r, out = random.Random(seed), []
    for k in range(n):
        kind, personal = ("phone", "email", "card", "secret")[k % 4], k // 4 % 2 == 0
        before, after = "", r.choice(("", ".", ",", " ", " - ", " and", "\n"))
        if kind == "secret":
            planted = r.choice(SETTINGS) + r.choice(JOINS) + (key(r) if personal else r.choice(WORDS))
        elif personal:
            planted = filled(r.choice({"phone": PHONES, "email": MAILS, "card": CARDS}[kind]), r)
            if kind == "card" and r.random() < 0.4:
                # other digits around it
                before, after = r.choice((("", " 123"), ("", " 12/27"), ("", " 2027"), ("12 ", ""), ("7 ", " 0#"), ("", " " + filled(r.choice(CARDS), r))))
        else:
            planted = filled(r.choice(NOT_MAILS if kind == "email" else NUMBERS), r)
        cue = r.choice(CUES)
        head = f"{r.choice(FILLER)} {cue} {before}" if cue else f"{r.choice(FILLER)} {before}"
        out.append({"id": k, "text": f"{head}{planted}{after} {r.choice(FILLER)}", "start": len(head), "end": len(head) + len(planted), "kind": kind, "personal": personal})
    return out
