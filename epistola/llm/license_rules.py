"""Licence signature rules: hand-written names of licences and notices (``license_notices``), and for each licence its tag and, for each name, grants of it.

Rules match the words of a text: lower-cased runs of letters and digits, one space between them, so
line breaks, quotes and punctuation never matter. Each rule has a keyword that any match must hold; a short keyword
is looked for as a whole word, unless the rule is ``inside``: then it may be part of a longer one (gplv2).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .license_notices import NOTICES, PLAIN

# The phrases whose places are counted, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Licences: SPDX identifier (public list), and the names by which texts call them, as regular expressions over words.
LICENSES = {
    "Apache-1.1": ["apache software license(?: version)? 1 1"],
    "Apache-2.0": ["apache license(?: version)? 2 0", "apache license v2", "apache 2 0", "asl 2 0"],
    "MIT": ["mit license", "expat license", "mit x11 license"],
    "X11": ["x11 license"],
    "ISC": ["isc license"],
    "BSD-2-Clause": ["(?:2|two) clause bsd license", "simplified bsd license", "freebsd license", "bsd 2 clause"],
    "BSD-3-Clause": ["(?:3|three) clause bsd license", "(?:new|revised|modified) bsd license", "bsd 3 clause"],
    "BSD-4-Clause": ["(?:4|four) clause bsd license", "original bsd license", "bsd 4 clause"],
    "0BSD": ["zero clause bsd license", "bsd zero clause license"],
    "GPL-1.0": ["gnu general public license(?: version)? 1(?: 0)?", "gpl v?1(?: 0)?"],
    "GPL-2.0": ["gnu general public license(?: version| v)? ?2(?: 0)?", "gpl ?v?2(?: 0)?"],
    "GPL-3.0": ["gnu general public license(?: version| v)? ?3(?: 0)?", "gpl ?v?3(?: 0)?"],
    "LGPL-2.0": ["gnu library general public license(?: version)? 2(?: 0)?"],
    "LGPL-2.1": ["gnu lesser general public license(?: version| v)? ?2 1", "lgpl ?v?2 1"],
    "LGPL-3.0": ["gnu lesser general public license(?: version| v)? ?3(?: 0)?", "lgpl ?v?3(?: 0)?"],
    "AGPL-3.0": ["gnu affero general public license(?: version| v)? ?3(?: 0)?", "agpl ?v?3(?: 0)?"],
    "GFDL-1.2": ["gnu free documentation license(?: version)? 1 2"],
    "GFDL-1.3": ["gnu free documentation license(?: version)? 1 3"],
    "MPL-1.1": ["mozilla public license(?: version)? 1 1", "mpl 1 1"],
    "MPL-2.0": ["mozilla public license(?: version| v)? ?2(?: 0)?", "mpl 2 0"],
    "EPL-1.0": ["eclipse public license(?: version| v)? ?1(?: 0)?"],
    "EPL-2.0": ["eclipse public license(?: version| v)? ?2(?: 0)?"],
    "CDDL-1.0": ["common development and distribution license(?: version)? 1 0", "cddl 1 0"],
    "CDDL-1.1": ["common development and distribution license(?: version)? 1 1", "cddl 1 1"],
    "CPL-1.0": ["common public license(?: version)? 1 0"],
    "IPL-1.0": ["ibm public license(?: version)? 1 0"],
    "Artistic-1.0": ["artistic license(?: version)? 1 0"],
    "Artistic-2.0": ["artistic license(?: version)? 2 0"],
    "Zlib": ["zlib license", "zlib libpng license"],
    "Libpng": ["libpng license"],
    "BSL-1.0": ["boost software license(?: version)?(?: 1 0)?"],
    "BUSL-1.1": ["business source license(?: version)?(?: 1 1)?"],
    "SSPL-1.0": ["server side public license(?: version)?(?: 1)?"],
    "Elastic-2.0": ["elastic license(?: version)? 2 0"],
    "Unlicense": ["the unlicense", "unlicense org"],
    "WTFPL": ["do what the fuck you want to public license", "wtfpl"],
    "CC0-1.0": ["cc0(?: 1 0)?", "creative commons zero"],
    "CC-BY-3.0": ["cc by 3 0", "creative commons attribution 3 0"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0"],
    "CC-BY-SA-3.0": ["cc by sa 3 0", "creative commons attribution sharealike 3 0"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0"],
    "CC-BY-NC-3.0": ["cc by nc 3 0", "creative commons attribution noncommercial 3 0"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0"],
    "CC-BY-NC-ND-4.0": ["cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0"],
    "ODbL-1.0": ["open database license", "odbl(?: 1 0)?"],
    "PDDL-1.0": ["public domain dedication and license", "pddl(?: 1 0)?"],
    "ODC-By-1.0": ["open data commons attribution license"],
    "OFL-1.1": ["sil open font license(?: version)?(?: 1 1)?"],
    "PSF-2.0": ["python software foundation license(?: version)?(?: 2)?"],
    "Ruby": ["ruby license"],
    "PHP-3.01": ["php license(?: version)?(?: 3 01)?"],
    "PostgreSQL": ["postgresql license"],
    "OpenSSL": ["openssl license"],
    "NCSA": ["university of illinois ncsa open source license"],
    "ECL-2.0": ["educational community license(?: version)? 2 0"],
    "EUPL-1.2": ["european union public licen[cs]e(?: version)?(?: 1 2)?", "eupl 1 2"],
    "MS-PL": ["microsoft public license"],
    "MS-RL": ["microsoft reciprocal license"],
    "OSL-3.0": ["open software license(?: version)? 3 0"],
    "AFL-3.0": ["academic free license(?: version)? 3 0"],
    "QPL-1.0": ["q public license(?: version)? 1 0"],
    "Vim": ["vim license"],
    "W3C": ["w3c software (?:notice and )?license"],
    "UPL-1.0": ["universal permissive license(?: version)?(?: 1 0)?"],
    "MulanPSL-2.0": ["mulan permissive software license(?: version| v)? ?2"],
    "OpenRAIL-M": ["open ?rail m license"],
    "Llama-2": ["llama 2 community license"],
    "Proprietary": ["proprietary license"],
}

# Names whose keyword can't be read from the expression: its word runs on into optional parts.
KEYWORDS = {"gpl ?v?2(?: 0)?": "gpl", "gpl ?v?3(?: 0)?": "gpl", "cc0(?: 1 0)?": "cc0", "odbl(?: 1 0)?": "odbl", "pddl(?: 1 0)?": "pddl"}

@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keyword: str
    pattern: re.Pattern
    priority: int
    weight: float
    inside: bool = False


def _keyword(pattern: str) -> str:
    """The longest word that every match holds."""
    plain = re.sub(r"\((?:\?:)?[^()]*\)\??|\[[^\]]*\]\S*|\S*[?*+{}|\\]\S*", " ", pattern)
    return max(plain.split() or [""], key=len)


def _rule(name: str, label: str, pattern: str, priority: int, weight: float, keyword: str | None = None, inside: bool = False) -> Rule:
    return Rule(name, label, keyword or _keyword(pattern), re.compile(f"(?<![^ ])(?:{pattern})(?![^ ])"), priority, weight, inside)


def build_rules() -> list[Rule]:
    """Ordered: notices first, then tags, grants, names, fields and names without a version; the base phrases last."""
    rules = [_rule(f"notice-{i}", label, pattern, 90, 0.95, keyword) for i, (label, keyword, pattern) in enumerate(NOTICES)]
    rules += [_rule(f"plain-{i}", label, pattern, 50, 0.6, keyword) for i, (label, keyword, pattern) in enumerate(PLAIN)]
    for spdx, names in LICENSES.items():
        tag = re.escape(re.sub(r"[^a-z0-9]+", " ", spdx.lower())).replace(r"\ ", " ")
        rules.append(_rule(f"spdx-{spdx}", spdx, f"spdx license identifier {tag}(?: only| or later)?", 85, 0.99, "spdx"))
        rules.append(_rule(f"field-{spdx}", spdx, f"licen[cs]e {tag}", 60, 0.6, max(tag.split(), key=len)))
        for k, name in enumerate(names):
            key, inside = KEYWORDS.get(name) or _keyword(name), name in KEYWORDS
            grant = f"(?:licensed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms (?:and conditions )?of )?(?:the |a )?{name}"
            rules.append(_rule(f"grant-{spdx}-{k}", spdx, grant, 80, 0.9, key, inside))
            rules.append(_rule(f"name-{spdx}-{k}", spdx, name, 70, 0.7, key, inside))
    rules += [_rule(f"base-{label}", label, phrase, 10, 0.5, max(phrase.split(), key=len)) for phrase, label in BASE.items()]
    return rules
