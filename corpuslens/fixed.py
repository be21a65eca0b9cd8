"""Patterns, word lists, thresholds and names that results depend on.

They are stated once, as text.  Patterns are in the common part of the Java and Python
dialects; ``JAVA`` and ``JAVA_I`` are the flags that make Java read them as Unicode.
"""

JAVA, JAVA_I = "(?U)", "(?iU)"

# ---- fixed values: run kinds and categories
RUN_KINDS = ("segmentation", "analyse", "doublons", "anonymisation", "embeddings", "typologie", "transcription")
CATEGORIES = ("CC", "CO", "CR", "IL")
FRONT_PAGES = {"CC": 2, "CO": 0, "CR": 0, "IL": 0}
END_MARK = "Fin des pages écrites"
MIN_PAGE_CHARS, QUALITY_THRESHOLD = 10, 0.3

# ---- fixed values: reading text
EMPTY_PAGE = r"\b(?:image|page|document|scan)\b[^.\n]{0,80}\b(?:aucun texte|pas de texte|sans (?:texte|écriture)|vide|vierge|blanche)\b"
EMPTY_PAGE_CHARS = 300
MAX_PAGE_CHARS, MAX_PAGE_WORDS = 12_000, 2_000
GRAM_WORDS, GRAM_WIDTH, GRAM_RATIO = 100, 8, 0.5
LINE_COUNT, LINE_RATIO = 50, 0.2

# ---- fixed values: segmentation
MONTHS = "janvier|février|fevrier|mars|avril|mai|juin|juillet|août|aout|septembre|octobre|novembre|décembre|decembre"
DATE_LINE = rf"^(?:[A-Za-zÀ-ÿ][^,.!?]{{0,40}},\s*)?le\s+\d{{1,2}}(?:er)?\s+(?:{MONTHS})\s+\d{{4}}\s*[,.]?\s*$"
NUMERIC_DATE_LINE = r"^(?:[A-Za-zÀ-ÿ][^,.!?]{0,40},\s*)?(?:le\s+)?\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}\s*[,.]?\s*$"
SALUTATION_LINE = r"^(?:monsieur|madame|mesdames|messieurs|cher|chère|chers|chères)\b[^.!?]{0,60}[,:]?\s*$"
NUMBERED_LINE = r"^(?:contribution|doléance|doleance|fiche|témoignage|temoignage)\s*(?:n\s*[°ºo]?\s*|num[ée]ro\s*)?\d+"
RULE_LINE = r"^\s*([-_*=~—–])(?:\s*\1){4,}\s*$"
CLOSING = r"(je vous prie d'agr[ée]|veuillez agr[ée]|veuillez recevoir|veuillez croire|dans l'attente|cordialement|salutations|respectueusement|sincèrement)"
OPENINGS = (("separateur", RULE_LINE), ("numerotation", NUMBERED_LINE), ("date", DATE_LINE), ("date", NUMERIC_DATE_LINE), ("apostrophe", SALUTATION_LINE))
MIN_SEGMENT_CHARS, SIGNATURE_LINES, SIGNATURE_LINE_CHARS = 80, 4, 60

# ---- fixed values: duplicates
SHINGLE_WORDS, SIGNATURE_SIZE, BAND_COUNT, SIMILARITY, SIMILARITY_FLOOR = 5, 128, 32, 0.8, 0.5
MINHASH_SEED, TOP_GROUPS = 20260910, 10

# ---- fixed values: typology signals (name, zone, ignore case, pattern)
OPENING_CHARS, CLOSING_CHARS, PLAUSIBLE_SHARE, PLAUSIBLE_MIN, SHORT_WORDS = 500, 600, 0.5, 12, 250
PLAUSIBLE_WORD = r"\b[a-zà-öø-ÿ]{3,}\b"
SIGNALS = (
    ("appel", "opening", False, r"\b(?:Monsieur\s+l[ea]\s+(?:Président|Maire|Préfet|Ministre|Députée?)|Madame\s+l[ea]\s+(?:Présidente|Maire|Préfète|Ministre|Députée?)|Madame,?\s*(?:et\s+)?Monsieur|Monsieur,?\s*(?:et\s+)?Madame|Mesdames,?\s*Messieurs)"),
    ("objet", "opening", True, r"(?:^|\n)\s*Objet\s*:"),
    ("politesse", "closing", True, r"(?:Veuillez\s+(?:agréer|croire|recevoir)|[Jj]e\s+vous\s+prie\s+d[e’']\s?agréer|sentiments\s+(?:distingués|respectueux|dévoués|les\s+meilleurs)|salutations\s+(?:distinguées|respectueuses)|l[’']expression\s+de\s+m[ae]s?\s+(?:haute\s+considération|sentiments))"),
    ("transmission", "opening", True, r"(?:^|\n)\s*Objet\s*:[^\n]{0,80}(?:cahier|doléance|doleance|expression|contribution|grand\s+débat)"),
    ("transmission", "all", True, r"\b(?:vous\s+(?:trouverez|prie\s+de\s+trouver)|je\s+vous\s+(?:transmets|adresse|fais\s+parvenir)|ci-joint|veuillez\s+trouver)\b[^.\n]{0,120}(?:cahier|registre|contributions?|doléances?)"),
    ("signature_elu", "closing", False, r"(?:^|\n)\s*(?:L[ea]\s+Maire|Le\s+Premier\s+adjoint|L[ea]\s+Maire\s+de|Pour\s+le\s+conseil\s+municipal|L[ea]\s+Président[e]?\s+d[eu])\b"),
    ("signature_elu", "all", False, r"[Jj]e\s+soussign[ée]s?[^.\n]{0,60}\bMaire\b"),
    ("conseil_municipal", "all", True, r"\b(?:le\s+conseil\s+municipal|délibération\s+du\s+conseil|séance\s+du\s+conseil)"),
    ("entete_mairie", "opening", False, r"(?:^|\n)\s*(?:MAIRIE|Mairie\s+de|COMMUNE\s+DE|Commune\s+de|VILLE\s+DE|Ville\s+de|Hôtel\s+de\s+[Vv]ille|Cabinet\s+du\s+Maire)\b"),
    ("soussignes_pluriel", "all", False, r"[Nn]ous,?\s+soussign[ée]s"),
    ("nous_collectif", "all", False, r"\b[Nn]ous,?\s+(?:les\s+)?(?:habitants|citoyens|usagers|membres|adhérents|salariés|retraités|agriculteurs|commerçants|parents)\b"),
    ("organisation", "all", False, r"\b(?:l[’']association\s+[A-ZÀ-Ÿ]|le\s+syndicat\s+[A-ZÀ-Ÿ]|la\s+section\s+(?:syndicale|locale)|le\s+collectif\s+[A-ZÀ-Ÿ]|notre\s+(?:association|syndicat|collectif|fédération)|la\s+fédération\s+[A-ZÀ-Ÿ]|le\s+comité\s+[A-ZÀ-Ÿ])"),
    ("petition", "all", False, r"\b[Pp]étition\b"),
    ("formulaire", "all", False, r"(?:^|\n)\s*(?:Nom\s+et\s+prénom|Nom\s*:|Prénom\s*:)\s*(?:\n|$)|[Ff]ormulaire\s+à\s+remplir|[Rr]ayez\s+la\s+mention"),
    ("premiere_personne", "all", False, r"\b[Jj]e\s+(?:suis|pense|demande|propose|souhaite|trouve|vis|vais|veux|travaille|paie|paye|gagne|constate|estime|voudrais|aimerais|crois|considère|réclame|dénonce|refuse|dois|peux|sais|comprends|subis)\b|\b[Jj][’']\s?(?:ai|aimerais|estime|espère|habite|attends|exerce|observe|entends|écris|ajoute|insiste|approuve)\b|\b(?:à\s+titre\s+personnel|en\s+tant\s+que\s+(?:citoyen|citoyenne|retraité|retraitée|salarié|salariée|artisan|agriculteur|mère|père))\b"),
    ("situation_personnelle", "all", False, r"\b(?:ma\s+retraite|mon\s+salaire|mes\s+enfants|ma\s+femme|mon\s+mari|mon\s+épouse|mon\s+métier|mon\s+entreprise|ma\s+pension|mon\s+loyer|mes\s+impôts|mon\s+âge|ma\s+santé)\b"),
)

# ---- fixed values: personal-data forms (kind, detector, ignore case, pattern), in order
STREETS = "rue|avenue|av|boulevard|bd|impasse|allee|allée|chemin|route|place|quai|lotissement|hameau|residence|résidence|cours|square|voie|sentier"
CLAUSE_WORDS = "ou|où|que|qui|quand|dans|chez|et|avec|pour|par|sous|depuis|car|mais|je|j|tu|il|elle|on|nous|vous|ils|elles|est|sont|etait|était"
FORMS = (
    ("institution", "email_institution", True, r"\b[\w.+-]*(?:mairie|commune|prefecture|préfecture|granddebat|grand-debat|cabinet|secretariat|secrétariat|accueil|contact)[\w.+-]*@[\w-]+\.[\w.-]{2,}\b|\b[\w.+-]+@[\w.-]*(?:mairie|ville|commune|granddebat|grand-debat)[\w.-]*\.[\w.-]{2,}\b|\b[\w.+-]+@[\w.-]+\.gouv\.fr\b"),
    ("email", "regex_email", False, r"\b[\w.+-]+@[\w-]+\.[\w.-]{2,}\b"),
    ("telephone", "regex_telephone", False, r"(?<!\d)(?:\+33[\s.-]?|0)\d(?:[\s.-]?\d{2}){4}(?!\d)"),
    ("iban", "regex_iban", False, r"\bFR\d{2}(?:[\s]?[A-Z0-9]{4}){5}[\s]?[A-Z0-9]{3}\b"),
    ("url", "regex_url", False, r"\bhttps?://\S+|\bwww\.[\w-]+\.[\w.-]+\b"),
    ("adresse", "regex_adresse", True, rf"\b\d{{1,4}}\s*(?:bis|ter|quater)?\s+(?:{STREETS})\b(?:\s+(?!(?:{CLAUSE_WORDS})\b)[\w'’-]+){{0,4}}"),
    ("nom", "civilite", False, r"\b(?:M\.|MM\.|Mme|Mmes|Mlle|Monsieur|Madame|Mademoiselle|Messieurs|Mesdames)(?:\s+[A-ZÀ-Ÿ][\w'’-]+){1,3}"),
    ("role_public", "role_public", True, r"\b(?:le\s+)?(?:Président\s+de\s+la\s+République|Premier\s+ministre|ministre\s+(?:de|des|du)\s+[\w'’\s-]{3,30}|Préfet|Préfète|Maire|député|députée|sénateur|sénatrice|Assemblée\s+nationale|Sénat)\b"),
)
NOT_PERSONAL = ("role_public", "institution", "lieu")
MARKERS = {"email": "[courriel]", "telephone": "[téléphone]", "iban": "[IBAN]", "url": "[lien]", "adresse": "[adresse]", "nom": "[nom]"}
OTHER_MARKER = "[occulté]"
SIGNATURE_CHARS, SIGNATURE_TAIL = 40, 4
NER_THRESHOLDS, NER_CHARS = {"nom": 0.4, "lieu": 0.6, "institution": 0.6}, 1200

# ---- fixed values: search
SEARCH_LIMIT, SEARCH_MAX, WINDOW_CHARS, MIN_PREFIX, EDGE_CHARS = 20, 200, 260, 4, 40
QUERY_WORDS = ("or", "ou", "and", "et")

# ---- fixed values: measures
THRESHOLDS = (0.1, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5)
POPULATION_STRATA = ((0, 500, "< 500"), (500, 2000, "500-2000"), (2000, 10000, "2000-10000"), (10000, None, ">= 10000"))
OUTSIDE, UNKNOWN, MISSING = "hors grille", "inconnue", "N/C"
TOP_TOPICS, LEAST_COVERED, GOLD_QUALITY, GOLD_CHARS = 25, 8, 0.9, (800, 4000)
RENDER_DPI, REDRAW_SEEDS = 300, (0, 1, 2, 3)
BANDS = (("A", 5, None), ("B", 3, 4), ("C", 0, 2))
SAMPLE_FLOOR, SAMPLE_SIZE, SAMPLE_SEED = 10, 60, 20260910
DELIVERY_RATE, DELIVERY_CHARS, DELIVERY_SAMPLE = 0.3, 40, 50
LOT_BYTES, ABSENT_CODE, CHAIN_HOPS = 400 << 20, "00000", 10
