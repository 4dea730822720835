"""Rule tables. Each is a parameter of the functions that use it; these are the defaults."""

from __future__ import annotations

# Results depend on these patterns, words, weights and their order.

#: +0.25 each, in any case.
NEED = (
    (r"\d+(\.\d+)?\s*%", "percentage_claim"),
    (r"\d+(\.\d+)?\s*(times|fold|x)\s+(faster|slower|better|higher|lower)", "comparative_numerical"),
    (r"(achieves|reaches|attains)\s+\d+", "achievement_claim"),
    (r"(accuracy|precision|recall|F1)\s*(of|:)\s*\d+", "metric_claim"),
    (r"(using|with|via|through)\s+[A-Z][a-z]+\d*", "method_reference"),
    (r"(BERT|GPT|ResNet|VGG|Transformer|LSTM|CNN|RNN)\b", "named_method"),
    (r"\b(our|we)\s+(propose|present|introduce|develop)\b", "own_contribution"),
    (r"\b(shown|demonstrated|proven|established|found)\s+(that|to)\b", "factual_claim"),
    (r"\b(according\s+to|based\s+on|as\s+reported\s+by)\b", "source_reference"),
    (r"\b(previously|recently|earlier)\s+(shown|demonstrated|proven|reported)\b", "prior_work"),
    (r"\b(outperforms|surpasses|exceeds|beats)\b", "comparative_claim"),
    (r"\b(better|worse|higher|lower|faster|slower)\s+than\b", "comparison"),
    (r"\b(state-of-the-art|SOTA|best|leading)\b", "sota_claim"),
    (r"\b(discovered|revealed|identified|observed|measured)\s+(that|a|the)\b", "finding_claim"),
    (r"\b(suggests|indicates|implies|shows)\s+that\b", "implication_claim"),
    (r"\b(the\s+results|our\s+experiments|the\s+study)\s+(show|demonstrate|reveal)\b", "result_claim"),
    (r"\b(p-value|confidence\s+interval|statistically\s+significant)\b", "statistical"),
    (r"\b(nanometer|micrometer|millimeter|GHz|MHz|Tesla|Kelvin)\b", "measurement"),
)
#: -0.15 each, in any case.
COMMON = (
    (r"\b(is|are)\s+(a|an|the)\s+(common|well-known|standard|basic)\b", "common_knowledge"),
    (r"\b(has|have)\s+been\s+(widely|extensively)\s+(used|studied|adopted)\b", "established_field"),
    (r"\b(many|several|numerous)\s+(studies|works|papers)\s+have\b", "general_reference"),
    (r"\b(it|this|these)\s+(is|are)\s+(known|clear|obvious|evident)\b", "obvious_fact"),
)
#: (pattern, group) of citations in a text.
CITATIONS = (
    (r"\\cite[pt]?\{([^}]+)\}", 1),
    (r"\\cite[pt]?\*\{([^}]+)\}", 1),
    (r"\\citeal?p?\{([^}]+)\}", 1),
    (r"\\textcite\{([^}]+)\}", 1),
    (r"\\parencite\{([^}]+)\}", 1),
    (r"\\autocite\{([^}]+)\}", 1),
    (r"@[a-zA-Z][a-zA-Z0-9:_-]+", 0),
    (r"\[([^\]]*,?\s*\d{4}[a-z]?,?\s*[^\]]*)\]", 1),
    (r"\([A-Z][a-z]+\s+et\s+al\.?,?\s*\d{4}[a-z]?\)", 0),
    (r"\([A-Z][a-z]+\s+and\s+[A-Z][a-z]+,?\s*\d{4}[a-z]?\)", 0),
)
STOP_WORDS = """the a an and or but in on at to for of with by from is are was were be been this that these those
it its they their we our has have had will would could should can may might must shall which who whom whose what
where when why how as than so very too also just only even not no""".split()
TITLE_STOP_WORDS = [*STOP_WORDS, *"here paper work study".split()]
DOMAIN_TERMS = "nbse2 mos2 wse2 tc tdgl epw dft tes raman phonon vortex".split()
ANCHORS = (
    ("superconducting qubit", r"\bsuperconduct(?:ing)?\s+qubit[s]?\b"),
    ("mechanical phonon", r"\bmechanical\s+phonon[s]?\b"),
    ("piezoelectric coupling", r"\bpiezoelectric\s+coupling\b"),
    ("acoustic mode", r"\bacoustic\s+mode[s]?\b"),
    ("phonon", r"\bphonon[s]?\b"),
    ("piezoelectric", r"\bpiezoelectric\b"),
    ("qubit", r"\bqubit[s]?\b"),
    ("acoustic", r"\bacoustic\b"),
    ("mechanical resonator", r"\bmechanical\s+resonator[s]?\b"),
    ("spin defect", r"\bspin\s+defect[s]?\b"),
    ("nv center", r"\bnv\s+cent(?:er|re)[s]?\b"),
)
SHARED_TERMS = ("critical temperature", "tc", "strain", "superconduct", "modulation")
VERBS = "demonstrate|report|show|present|develop|fabricate|realize|investigate|measure|observe|find"
CONTRIBUTION = (
    (rf"^(here\s+)?we\s+({VERBS})\b", 3.0),
    (r"^(in this work|in this paper|this work|this paper)\b", 2.5),
    (rf"\bwe\s+({VERBS})\b", 2.5),
    (r"\b(the results|our experiments|our measurements)\s+(show|demonstrate|reveal)\b", 2.2),
)
BACKGROUND = (
    (r"\b(promising platform|attracted (?:great |considerable )?attention|growing interest)\b", -2.5),
    (r"\b(in recent years|recent advances|recent progress)\b", -2.0),
    (r"\b(is|are)\s+(important|crucial|essential|key)\s+for\b", -1.7),
    (r"\b(has|have)\s+been\s+(widely|extensively)\s+(studied|used|investigated)\b", -1.7),
)
JOURNALS = {
    "Nature Communications": "Nat. Commun.",
    "Physical Review B": "Phys. Rev. B",
    "Physical Review D": "Phys. Rev. D",
    "Physical Review Letters": "Phys. Rev. Lett.",
    "Nature": "Nature",
    "Science": "Science",
    "Nano Letters": "Nano Lett.",
}
#: Of titles: (pattern, replacement in BibTeX, replacement in plain text), in order; None: not in that form.
TITLES = (
    (r"\n", " ", " "),
    (r"\\textbraceleft", "{", "{"),
    (r"\\textbraceright", "}", "}"),
    (r"\\_", "_", "_"),
    (r"\\\$", r"\$", r"\$"),
    (r"\{\{([A-Za-z0-9+-]+)\}\}", "{$1}", "{$1}"),
    (r"(?U)\{\s*([A-Za-z0-9+-]+)\s*\}", "{$1}", "{$1}"),
    (r"(?isU)<mml:mi>\s*He\s*</mml:mi>.*?<mml:mn>\s*3\s*</mml:mn>", "3He", "3He"),
    (r"<[^>]+>", " ", " "),
    (r"(?U)\s+", " ", " "),
    (r"(?U)^\s+|\s+$", "", ""),
    (r"\$_2\$", "2", "2"),
    (r"\$_", "", ""),
    (r"\$\{+([A-Z])\}*_\{?([A-Za-z0-9+-]+)\}?\$", r"{\$$1_$2\$}", "$1$2"),
    (r"(?U)(?<!\w)\$?([A-Z])_\{?([A-Za-z0-9+-]+)\}?\$?(?!\w)", r"{\$$1_$2\$}", "$1$2"),
    (r"\{\{(\$[^$]+\$)\}\}", "{$1}", None),
    (r"(?<!\{)(\$[^$]+\$)(?!\})", "{$1}", None),
    (r"\$([^$]+)\$", None, "$1"),
    (r"[{}]", None, ""),
    (r" andV-I", " and V-I", " and V-I"),
    (r"V-Icharacteristics", "V-I characteristics", "V-I characteristics"),
    (r"NbSe 2", "NbSe2", "NbSe2"),
)
#: Of identifiers.
DOI = r"""10\.\d{4,9}/[^\s\?"<>#]+"""
ARXIV_ID = r"\d{4}\.\d{4,5}"
ARXIV_URL = r"arxiv\.org/(?:abs|pdf)/(\d+\.\d+)"
PUBMED_URL = r"pubmed\.ncbi\.nlm\.nih\.gov/(\d+)"
