"""Keyword lists of the classifiers and of the question router, and field names. They must stay as they are."""

PAGE_SIGNATURES = {
    "invoice": (2.0, ["invoice", "facture", "rechnung", "faktura", "factura", "ttc", "tva", "vat", "ht:", "total ttc", "montant", "numéro de facture", "invoice number", "invoice no"]),
    "contract": (1.5, ["contract", "agreement", "clause", "terms and conditions", "contrat", "parties", "hereby agree", "effective date", "signature", "witnesseth", "indemnification", "confidential"]),
    "report": (1.5, ["report", "summary", "conclusion", "findings", "analysis", "rapport", "résumé", "synthèse", "conclusion", "introduction", "methodology", "appendix"]),
    "correspondence": (1.5, ["dear", "sincerely", "letter", "memorandum", "attention", "objet:", "reference:", "madame", "monsieur", "cordially", "best regards", "yours faithfully", "to the"]),
    "form": (1.5, ["form", "application", "registration", "please fill", "formulaire", "inscription", "case à cocher", "name:", "email:", "phone:", "date of birth"]),
}
PAGE_KEYWORDS = {
    "INVOICE": ["invoice", "facture", "bill", "amount due", "total due", "remittance"],
    "DELIVERY_NOTE": ["delivery note", "packing slip", "bon de livraison", "received", "goods"],
    "PURCHASE_ORDER": ["purchase order", "po number", "order date", "buyer"],
    "CONTRACT": ["agreement", "contract", "terms and conditions", "party", "effective date"],
    "BANK_STATEMENT": ["bank statement", "account statement", "opening balance", "closing balance", "iban"],
    "ID_CARD": ["id card", "passport", "driver license", "nationality", "date of birth"],
    "RECEIPT": ["receipt", "payment", "thank you", "cash", "pos terminal"],
}
FRENCH_INDICATORS = [
    "tva", "ttc", "ht", "montant", "facture", "numéro", "numero", "fournisseur", "client", "adresse", "date", "total", "prix",
    "quantité", "quantite", "unité", "unite", "désignation", "designation", "libellé", "libelle", "réf", "ref", "siret",
    "taux", "net à payer", "net a payer", "euros", "euro", "sous-total", "sous total", "remise", "conditions de règlement",
    "condition de reglement", "échéance", "echeance", "avoir",
]
#: Words of a table header and the item fields that they stand for, in the order in which they are tried.
HEADERS = [
    ("description", "description"), ("designation", "description"), ("désignation", "description"), ("libellé", "description"), ("libelle", "description"), ("article", "description"),
    ("product", "description"), ("service", "description"), ("qty", "quantity"), ("quantity", "quantity"), ("quantité", "quantity"), ("quantite", "quantity"), ("qté", "quantity"),
    ("qte", "quantity"), ("unit", "uom"), ("uom", "uom"), ("unité", "uom"), ("unite", "uom"), ("price", "unit_price"), ("unit price", "unit_price"), ("prix", "unit_price"),
    ("prix unitaire", "unit_price"), ("pu", "unit_price"), ("p.u", "unit_price"), ("p.u.", "unit_price"), ("total", "total"), ("amount", "total"), ("montant", "total"),
    ("sub total", "sub_total"), ("subtotal", "sub_total"), ("sous-total", "sub_total"), ("sous total", "sub_total"), ("ht", "sub_total"), ("vat", "vat_rate"), ("vat rate", "vat_rate"),
    ("tva", "vat_rate"), ("taux tva", "vat_rate"), ("%", "vat_rate"), ("tax", "vat_rate"),
]
#: Words of a question and the named query that they lead to, in the order in which they are tried.
ROUTES = [
    *((w, "suppliers") for w in ("supplier", "fournisseur", "vendor", "company", "société", "entreprise")),
    *((w, "financial") for w in ("financial", "financier", "total", "montant", "revenue", "spend", "money", "cost", "price", "prix")),
    *((w, "accuracy") for w in ("accuracy", "accurate", "précision", "exactitude", "precision", "recall", "rappel", "f1")),
    *((w, "performance") for w in ("performance", "timing", "latency", "throughput", "speed", "vitesse", "time", "temps", "memory", "mémoire", "cache")),
    *((w, "quality") for w in ("quality", "qualité", "flag", "drapeau", "faithful", "fidélité", "confidence", "confiance")),
    *((w, "recommendations") for w in ("recommend", "recommandation", "suggest", "improve", "améliorer", "strategy", "stratégie", "business")),
    *((w, "line_items") for w in ("ligne", "line", "article", "description")),
    *((w, "dates") for w in ("date", "dates")),
]
KV_LABELS = ["total", "tva", "ttc", "ht", "montant", "date", "facture", "invoice", "n°", "n.", "ref", "client", "adresse", "tel"]
ERP_COLUMNS = {"NUMBER": "InvoiceNumber", "SUPPLIER": "SupplierName", "ADDRESS": "SupplierAddress", "INVOICE_DATE": "InvoiceDate", "TOTAL": "NetAmount", "TOTAL_AMOUNT": "GrossAmount"}
#: Colours of boxes: of ground truth, and of labels without a colour of their own.
TRUTH_COLOUR, OTHER_COLOUR = "#3b82f6", "#95a5a6"
LABEL_COLOURS = {
    "NUMBER": "#ff4757", "SUPPLIER": "#2ed573", "ADDRESS": "#1e90ff", "INVOICE_DATE": "#ffa502", "INVOICE_DUE_DATE": "#ff6348", "PO_NUMBER": "#a29bfe", "TOTAL": "#00d2d3",
    "TOTAL_AMOUNT": "#6c5ce7", "TOTAL_UNTAXED": "#7bed9f", "TAX_AMOUNT": "#e056fd", "LINE/DESCRIPTION": "#f9ca24", "LINE/QUANTITY": "#0abde3", "LINE/UOM": "#26de81", "LINE/PRICE": "#45aaf2",
    "LINE/SUB_TOTAL": "#fc5c65", "LINE/TAX": "#8854d0", "O": "#95a5a6",
}
#: Words that tell French and English questions apart; entries of two words never equal a word.
FRENCH_KEYWORDS = [
    "quels", "quelle", "quelles", "quel", "combien", "montant", "total", "fournisseur", "facture", "ligne", "description", "prix", "quantité",
    "précision", "rappel", "confiance", "fidélité", "qualité", "drapeau", "recommandation", "améliorer", "stratégie", "temps", "performance",
    "vitesse", "mémoire", "cache", "exactitude", "taux", "pourcentage", "afficher", "montrer", "liste", "résumé", "synthèse", "analyse",
    "sont", "mentionnés", "extraits", "trouvés", "présents", "disponibles", "les", "des", "de", "du", "la", "le", "et", "est", "dans", "sur",
    "pour", "avec", "par", "pas", "que", "qui", "ce", "cette", "ces", "totaux", "sous-total", "taxe", "tva", "date", "numéro", "adresse",
    "articles", "produits", "services", "unités", "mesure",
]
ENGLISH_KEYWORDS = [
    "what", "which", "how", "how many", "how much", "total", "amount", "supplier", "vendor", "invoice", "line", "description", "price", "quantity",
    "accuracy", "precision", "recall", "confidence", "faithfulness", "quality", "flag", "recommendation", "improve", "strategy", "time", "performance",
    "speed", "memory", "cache", "show", "list", "summary", "analysis", "are", "mentioned", "extracted", "found", "present", "available",
    "the", "and", "is", "in", "on", "for", "with", "by", "not", "totals", "subtotal", "tax", "vat", "date", "number", "address",
    "items", "products", "services", "units", "measure",
]
#: What marks a line as a title, what a title with numbers begins with, and its most words.
TITLE_KEYWORDS = ["invoice", "facture", "bill", "receipt"]
TITLE_STARTS = ["invoice", "facture", "your", "bill", "receipt", "statement"]
TITLE_WORDS_MOST = 10
