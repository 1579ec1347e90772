"""Word lists and tables that results depend on. All are parameters of the operators that use them."""

from __future__ import annotations

# fixed values: label keywords
KEYWORDS = {
    "Prevention": ["vaccine", "vaccination", "immunization", "immunisation", "antibody", "prophylaxis", "prevention", "immune response"],
    "Treatment": ["treatment", "therapy", "therapeutic", "drug", "clinical trial", "remdesivir", "antiviral", "intervention"],
    "Epidemiology": ["transmission", "outbreak", "epidemic", "pandemic", "spread", "incidence", "prevalence", "reproduction number", "contact tracing", "epidemiology", "case fatality"],
}
#: Keywords that occur in invented prose, for the same labels.
PROSE_KEYWORDS = {"Prevention": ["thing", "shed", "ble"], "Treatment": ["onan", "ndat", "ly"], "Epidemiology": ["hea", "resh", "wh"]}

# fixed values: known words that are never corrected
PROTECTED_WORDS = (
    "the a an and or but to of in on for with as at by is are was were be been being am this that these those it its it's "
    "they them their there then than i we you he she my our your his her any some no not do did done does can could may might must will would should"
).split()

# fixed values: words left alone by the noise generator
NOISE_STOP_WORDS = (
    "the and with from that this were was are for into over under than then have has had been being these those their there here such also using used"
).split()

# fixed values: words that are no topic terms
ACADEMIC_STOP_WORDS = (
    "study studies result results method methods data analysis analyses paper papers patient patients disease diseases clinical medical health "
    "research model models based using used use also may can could would should however therefore thus et al figure table approach system reported "
    "significant significantly increase decrease effect effects impact impacts high low new novel conclusion conclusions introduction background "
    "between within during before after among across throughout therein thereof because although towards toward furthermore thereby therein"
).split()

# fixed values: Greek letters and the names that replace them
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "κ": "kappa", "μ": "mu", "τ": "tau", "λ": "lambda",
    "Α": "alpha", "Β": "beta", "Γ": "gamma", "Δ": "delta", "Κ": "kappa", "Μ": "mu", "Τ": "tau", "Λ": "lambda",
}

# fixed values: pairs that scanned text confuses; each holds in both directions
_SCAN_PAIRS = (
    ("rn", "m"), ("nn", "m"), ("nm", "nn"), ("cl", "d"), ("ck", "d"), ("lc", "k"), ("li", "h"), ("lo", "b"), ("ol", "d"), ("vv", "w"), ("ii", "u"), ("fi", "h"), ("fl", "tl"), ("ri", "n"), ("in", "m"), ("cj", "g"), ("lI", "U"),
    ("0", "o"), ("0", "O"), ("0", "Q"), ("0", "D"), ("0", "C"), ("1", "l"), ("1", "I"), ("1", "i"), ("1", "|"), ("1", "t"), ("1", "f"), ("2", "z"), ("2", "Z"), ("3", "e"), ("4", "A"), ("5", "s"), ("5", "S"), ("6", "b"), ("6", "G"), ("7", "T"), ("7", "Y"), ("8", "B"), ("8", "g"), ("9", "g"), ("9", "q"),
    ("c", "e"), ("c", "o"), ("e", "o"), ("a", "o"), ("a", "e"), ("a", "s"), ("i", "j"), ("i", "l"), ("l", "t"), ("f", "t"), ("r", "n"), ("u", "v"), ("y", "v"), ("h", "b"), ("k", "x"), ("g", "q"), ("p", "q"), ("d", "b"), ("v", "r"),
    ("D", "O"), ("E", "F"), ("B", "E"), ("M", "N"), ("H", "N"), ("K", "X"), ("V", "U"), ("I", "L"), ("P", "R"),
    (".", ","), (":", ";"), ("-", "_"), ("'", "`"), ("!", "l"), ("(", "C"),
)
OCR_PAIRS = tuple(x for a, b in _SCAN_PAIRS for x in ((a, b), (b, a)))
# fixed values: letters that stand in for others
CHARACTER_CONFUSIONS = {"a": "aoe", "c": "ceo", "e": "eca", "i": "il", "l": "li", "m": "n", "n": "m", "o": "oa", "s": "sz", "u": "uv", "v": "uv", "z": "zs"}
#: name, probability that a word is edited, most edits a word
NOISE_LEVELS = (("mild", 0.035, 1), ("moderate", 0.070, 1), ("severe", 0.110, 2))

# fixed values: context of the domain rules
COVID_18 = ("covid-18", "covid18", "covd-18")
COVID_VARIANTS = (
    "covid19", "covid 19", "covid–19", "covid—19", "covid_19", "covid/19", "covid-2019", "covid2019", "covid 2019", "COVID19",
    "COVID-19", "Covid-19", "CoViD-19", "covid19.", "(covid19)", "covid19,", "covid-19,", "covid19-related", "covid19related", "covid19)",
)
VIRUS_CONFUSIONS = ("versus", "virtues", "verses")
VIRUS_BEFORE = ("corona", "covid", "covid-19", "sars", "mers", "hiv", "cov")
VIRUS_AFTER = ("infection", "infections", "variant", "variants", "pathogen", "epidemic")
CHANGE_WORDS = ("difference", "differences", "increase", "increases", "decrease", "decreases", "reduction", "reductions", "change", "changes")
