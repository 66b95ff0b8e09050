"""Phrase dictionaries and tuning constants.

Everything in this module is a FIXED VALUE: the pattern texts, their order and
the numbers must stay exactly as they are, because the operators' results are
defined by them.  Patterns are plain regular-expression sources and are always
matched without regard to case unless stated otherwise.
"""

from __future__ import annotations

# --- fixed values: scored phrases of the context detector ------------------

STRONG_PHRASES = [
    r"this (?:video|segment|portion|episode) is (?:brought to you|sponsored|made possible) by",
    r"(?:sponsored|presented) by",
    r"today'?s (?:video is )?sponsor",
    r"this (?:week|episode)'?s sponsor",
    r"our (?:sponsor|partner)",
    r"(?:a )?(?:quick |brief )?(?:word|message) from (?:our |today'?s )?sponsor",
    r"(?:video|episode) (?:is )?(?:sponsored|supported) by",
    r"made (?:this video )?possible by",
    r"thanks? to .{1,40} for (?:sponsoring|supporting|making this)",
    r"a (?:huge|big|special) thanks? to",
    r"brought to you by",
    r"partnered with",
    r"in partnership with",
    r"use (?:my |our )?(?:code|link|referral)",
    r"use code .{1,20} (?:at|for) checkout",
    r"(?:my|our|the) (?:affiliate |referral )?(?:code|link) (?:is |in )",
    r"if you (?:use|click) (?:my|the) link",
    r"link (?:is )?in (?:the )?description",
    r"click (?:the|my) link",
    r"check (?:them )?out at",
    r"go to .{1,40}\.com",
    r"head (?:on )?over to .{1,40}\.com",
    r"visit .{1,40}\.com",
    r"download .{1,30} (?:app|today|now|for free)",
    r"first \d+ (?:people|users|customers|subscribers)",
    r"(?:get |try ).{1,30} for free",
    r"free trial",
    r"\d+ (?:days?|months?) (?:free|trial)",
    r"free (?:\d+-)?(?:day|month|week) trial",
    r"percent off",
    r"\d+% off",
    r"(?:save|get) \d+%",
    r"discount code",
    r"promo code",
    r"coupon code",
    r"exclusive (?:discount|deal|offer|code) (?:for )?(?:my )?(?:viewers?|subscribers?|listeners?|audience)",
    r"(?:my |our )?viewers? (?:get|receive|save|can get)",
    r"thanks?\s+(?:again\s+)?to\s+[\w\s]{1,30}\s+for\s+sponsor",
    r"thank\s+[\w]+\s+for\s+(?:sponsor|partner)",
    r"\bthis\s+(?:video|episode)\s+(?:is\s+)?(?:sponsor|brought)",
    r"\btoday(?:'s|s)?\s+(?:video\s+)?sponsor\b",
    r"\bour\s+sponsor(?:s)?\b",
]

WEAK_PHRASES = [
    r"sign up",
    r"download the app",
    r"available (?:now )?at",
    r"money.?back guarantee",
    r"limited time",
    r"exclusive (?:deal|offer)",
    r"start (?:your )?(?:free )?(?:trial|subscription)",
    r"check (?:it|them) out",
    r"learn more",
    r"(?:scan|use) (?:the )?QR code",
    r"premium (?:plan|subscription|membership|account)",
    r"no ?(?:cost|charge|credit card)(?: required)?",
]

# A text that matches none of these scores zero in the context detector.
GATE_PHRASES = [
    r"sponsor",
    r"promo",
    r"coupon",
    r"affiliate",
    r"referral",
    r"brought\s+to\s+you",
    r"use\s+(?:my\s+|our\s+)?(?:code|link|referral)",
    r"(?:free|special)\s+trial",
    r"percent\s+off",
    r"\d+%\s+off",
    r"link\s+(?:is\s+)?in\s+(?:the\s+)?description",
    r"(?:visit|go\s+to|head\s+over\s+to)\s+\w+\.com",
    r"download\s+\w+\s+(?:app|today|now)",
    r"(?:get|try)\s+.{1,20}\s+for\s+free",
    r"sign\s+up",
    r"limited\s+time",
    r"money.?back\s+guarantee",
    r"exclusive\s+(?:deal|offer|discount|code)",
    r"thanks?\s+to\s+\w+\s+for\s+(?:sponsor|partner)",
    r"this\s+(?:video|episode)\s+(?:is\s+)?(?:sponsor|brought)",
    r"today.s\s+(?:video\s+)?sponsor",
    r"our\s+sponsors?\b",
]

# A cue with one of these opens a read: the start boundary may snap to it.
INTRO_PHRASES = [
    r"\bbefore (?:we|I) (?:get into|start|continue|dive)\b",
    r"\breal quick\b",
    r"\bquick(?:ly)? (?:want to|shout.?out)\b",
    r"\bspeaking of\b",
    r"\btake a (?:quick )?break\b",
    r"\bfirst,? (?:a )?(?:quick )?word\b",
]

# A cue with one of these resumes the content: the end boundary precedes it.
RETURN_PHRASES = [
    r"\banyway(?:s)?\b",
    r"\bwith that (?:said|out of the way)\b",
    r"\bback to (?:the|today|our|it)\b",
    r"\blet'?s (?:get back|continue|dive back)\b",
    r"\benough (?:about|of) that\b",
    r"\bnow (?:where were we|let'?s get back)\b",
    r"\bso(?: anyway)?,? (?:back|let'?s)\b",
]

# --- fixed values: phrases of the simple per-cue detector -------------------

SIMPLE_STRONG_PHRASES = [
    r"this (?:video|segment|portion) is (?:brought to you|sponsored|made possible) by",
    r"(?:sponsored|presented) by",
    r"today'?s sponsor",
    r"thanks to .{1,40} for sponsoring",
    r"a (?:huge|big|special) thanks? to",
    r"brought to you by",
    r"use (?:my |our )?(?:code|link)",
    r"use code .{1,20} (?:at|for) checkout",
    r"go to .{1,40}\.com",
    r"head (?:on )?over to .{1,40}\.com",
    r"visit .{1,40}\.com",
    r"check (?:them )?out at",
    r"click (?:the|my) link",
    r"link (?:is )?in (?:the )?description",
    r"first \d+ (?:people|users|customers|subscribers)",
    r"free trial",
    r"percent off",
    r"% off",
    r"discount code",
    r"promo code",
    r"coupon code",
]

SIMPLE_WEAK_PHRASES = [
    r"sign up",
    r"download the app",
    r"available (?:now )?at",
    r"money back guarantee",
    r"limited time",
    r"exclusive (?:deal|offer)",
    r"subscribe",
    r"premium",
]

# --- fixed values: localized "skip" wordings (some are case-sensitive) ------

SKIP_WORDINGS = [
    ("skip_ad", r"(?i)skip\s*ad"),
    ("skip_ads", r"(?i)skip\s*ads"),
    ("skip_end", r"(?i)skip$"),
    ("fr", r"(?i)passer"),
    ("de", r"(?i)überspringen"),
    ("es", r"(?i)saltar"),
    ("pt", r"(?i)pular"),
    ("ja", r"スキップ"),
    ("ko", r"광고 건너뛰기"),
    ("zh_hans", r"跳过"),
    ("zh_hant", r"跳過"),
    ("ru", r"(?i)пропустить"),
    ("tr", r"(?i)atla"),
    ("id", r"(?i)lewati"),
    ("th", r"ข้าม"),
    ("ar", r"تخطي"),
    ("hi", r"छोड़ें"),
]

# --- fixed values: 128-dim indicator vocabularies, 8 groups of 16 -----------
# Dims 0-47 differ between the two vocabularies, dims 48-127 are common.

_PIPELINE_HEAD = [
    # group 0: intro
    r"\bsponsored\s+by\b", r"\bthis\s+video\s+is\s+sponsored\b",
    r"\bbrought\s+to\s+you\s+by\b", r"\bour\s+sponsor\s+today\b",
    r"\btoday'?s\s+sponsor\b", r"\bpartnered\s+with\b",
    r"\bin\s+partnership\s+with\b", r"\bpaid\s+partnership\b",
    r"\baffiliate\b", r"\bpaid\s+promotion\b",
    r"\bproud\s+to\s+partner\b", r"\bthanks?\s+to\s+\w+\s+for\s+sponsoring\b",
    r"\bsponsor\s+of\s+(this|today'?s)\b", r"\bcheck\s+out\s+our\s+sponsor\b",
    r"\bspecial\s+thanks?\s+to\s+our\s+sponsor\b", r"\bsupported\s+by\b",
    # group 1: call to action
    r"\buse\s+code\b", r"\bpromo\s+code\b",
    r"\bdiscount\s+code\b", r"\bcoupon\s+code\b",
    r"\blink\s+in\s+(the\s+)?description\b", r"\blink\s+below\b",
    r"\bclick\s+the\s+link\b", r"\bsign\s+up\b",
    r"\bfree\s+trial\b", r"\btry\s+it\s+for\s+free\b",
    r"\bget\s+started\b", r"\bdownload\s+(the\s+)?(app|it|now)\b",
    r"\bvisit\s+\w+\s*\.\s*(com|io|org|net)\b", r"\bgo\s+to\b",
    r"\bhead\s+(over\s+)?to\b", r"\bcheck\s+(it\s+)?out\b",
    # group 2: offer
    r"\b\d+\s*%\s*off\b", r"\bfirst\s+\d+\s*(days?|months?|weeks?)\s+free\b",
    r"\bexclusive\s+(offer|deal|discount)\b", r"\blimited\s+(time\s+)?(offer|deal)\b",
    r"\bspecial\s+(offer|deal|discount|price)\b", r"\bsave\s+\d+\b",
    r"\bno\s+credit\s+card\s+required\b", r"\bcancel\s+anytime\b",
    r"\bmoney.back\s+guarantee\b", r"\bfor\s+a\s+limited\s+time\b",
    r"\bget\s+\d+\s*%\s*off\b", r"\bfree\s+shipping\b",
    r"\bfree\s+month\b", r"\btrial\s+period\b",
    r"\bno\s+charge\b", r"\bon\s+sale\b",
]

_EXTENSION_HEAD = [
    # group 0: intro
    r"\bsponsored by\b",
    r"\bbrought to you by\b",
    r"\btoday'?s sponsor\b",
    r"\bthis (?:video|episode|segment|portion) (?:is )?(?:sponsored|presented|made possible)\b",
    r"\bthanks? to .{1,40} for sponsoring\b",
    r"\ba (?:huge|big|special) thanks?\b",
    r"\bpartner(?:ed|ship)? with\b",
    r"\bpaid (?:promotion|partnership|advertisement)\b",
    r"\bofficial (?:sponsor|partner)\b",
    r"\bsponsor of this\b",
    r"\bpresented by\b",
    r"\bmade possible by\b",
    r"\bpowered by\b",
    r"\bin (?:association|partnership) with\b",
    r"\bsupported by\b",
    r"\baffiliate\b",
    # group 1: call to action
    r"\buse (?:my |our |the )?(?:code|link|coupon|promo)\b",
    r"\buse code [A-Z0-9]{3,}",
    r"\blink (?:is |in )?(?:the )?description\b",
    r"\bgo to .{1,40}\.(?:com|io|co|net|org)\b",
    r"\bhead (?:on )?over to\b",
    r"\bvisit .{1,40}\.(?:com|io|co)\b",
    r"\bcheck (?:them )?out\b",
    r"\bclick (?:the |my |that )?link\b",
    r"\bscan (?:the )?(?:qr|barcode)\b",
    r"\bswipe up\b",
    r"\btap (?:the )?link\b",
    r"\bin (?:the )?bio\b",
    r"\bdown(?:load|load the app)\b",
    r"\bsign up\b",
    r"\bget started\b",
    r"\btry (?:it |them )?(?:free|for free|today)\b",
    # group 2: offer
    r"\b\d+\s*%\s*off\b",
    r"\bpercent off\b",
    r"\bfree trial\b",
    r"\bdiscount code\b",
    r"\bpromo code\b",
    r"\bcoupon code\b",
    r"\bspecial (?:offer|deal|discount)\b",
    r"\bexclusive (?:deal|offer|discount)\b",
    r"\blimited time\b",
    r"\bmoney.?back guarantee\b",
    r"\bfirst \d+ (?:people|users|customers|subscribers|listeners)\b",
    r"\bno (?:cost|charge|commitment)\b",
    r"\bcancel anytime\b",
    r"\bno (?:risk|obligation)\b",
    r"\bfirst (?:month|year|week) free\b",
    r"\bsave \$?\d",
]

_COMMON_TAIL = [
    # group 3: product words
    r"\bapp\b", r"\bplatform\b", r"\bservice\b", r"\bsoftware\b",
    r"\bproduct\b", r"\bsubscription\b", r"\btool\b", r"\bsolution\b",
    r"\bpremium\b", r"\bpro\s+plan\b", r"\bplan\b", r"\baccount\b",
    r"\bwebsite\b", r"\bonline\b", r"\bdigital\b", r"\btech\b",
    # group 4: further intro wordings
    r"\bworking with\b", r"\bcollab(?:oration)?\s+with\b",
    r"\bbrand\s+(?:deal|collab|partnership)\b", r"\bendors(?:ed|ement|es)\b",
    r"\bgifted\s+by\b", r"\bsponsorship\b",
    r"\bcommercial\s+(?:break|message)\b", r"\bword\s+from\s+(?:our|today'?s)?\s*sponsor\b",
    r"\bmessage\s+from\s+(?:our|today'?s)\b", r"\bquick\s+(?:word|message|break)\s+from\b",
    r"\bpaid\s+collaboration\b", r"\bthis\s+(?:post|video)\s+(?:is\s+)?(?:an?\s+)?ad\b",
    r"\bproud\s+to\s+work\s+with\b", r"\bnew\s+sponsor\b",
    r"\blong.?time\s+sponsor\b", r"\bofficial\s+partner\b",
    # group 5: further calls to action
    r"\bshop\s+now\b", r"\bbuy\s+now\b",
    r"\border\s+(?:now|today)\b", r"\bget\s+yours?\b",
    r"\bclaim\s+(?:your|the)\b", r"\bgrab\s+yours?\b",
    r"\bfollow\s+(?:the\s+)?link\b", r"\bjoin\s+(?:now|today)\b",
    r"\bregister\s+(?:now|today)\b", r"\bbook\s+(?:a\s+)?(?:demo|call|consultation)\b",
    r"\bstart\s+(?:your\s+)?(?:free\s+)?trial\b", r"\bactivate\s+(?:your|the)\b",
    r"\bunlock\s+(?:your|the)\b", r"\bexclusive\s+link\b",
    r"\btap\s+(?:the\s+)?link\b", r"\bswipe\s+up\b",
    # group 6: further offers
    r"\bhalf\s+(?:off|price)\b", r"\bfree\s+shipping\b",
    r"\bno\s+credit\s+card\s+(?:needed|required|necessary)\b", r"\brisk.?free\b",
    r"\bat\s+no\s+(?:cost|charge|fee)\b", r"\bintroductory\s+(?:price|offer|rate)\b",
    r"\bearly\s+(?:access|bird)\b", r"\blifetime\s+(?:deal|access|membership)\b",
    r"\bfor\s+(?:just|only)\s+\$?\d", r"\bstarting\s+(?:at|from)\s+\$?\d",
    r"\bper\s+(?:month|year|week)\b", r"\bfree\s+(?:forever|for\s+life)\b",
    r"\b\d+.day\s+(?:free\s+)?trial\b", r"\bno\s+hidden\s+fees?\b",
    r"\bguaranteed\b", r"\bbest\s+price\b",
    # group 7: product categories
    r"\bonline\s+course\b", r"\bmaster\s*class\b",
    r"\bweb\s+hosting\b", r"\bdomain\s+name\b",
    r"\bpassword\s+manager\b", r"\bantivirus\b",
    r"\bcloud\s+storage\b", r"\bstreaming\s+(?:service|platform)\b",
    r"\binvesting\s+(?:app|platform)\b", r"\bfitness\s+(?:app|tracker|plan)\b",
    r"\bprotein\s+(?:powder|shake)\b", r"\bsleep\s+(?:app|tracker|aid)\b",
    r"\bbusiness\s+(?:tool|software)\b", r"\be.?commerce\b",
    r"\bsaas\b", r"\bfintech\b",
]

VOCAB_PIPELINE = _PIPELINE_HEAD + _COMMON_TAIL
VOCAB_EXTENSION = _EXTENSION_HEAD + _COMMON_TAIL

N_DIMS = 128
GROUP_SIZE = 16
GROUP_WEIGHTS = [3.0, 1.5, 1.5, 0.5, 2.0, 1.0, 1.0, 0.5]

# --- fixed values: character references undone when captions are read -------

ENTITIES = [
    ("&amp;", "&"),
    ("&#39;", "'"),
    ("&quot;", '"'),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&nbsp;", " "),
]

# --- fixed values: caption container preference (lower is better) -----------

FORMAT_RANK = {"vtt": 0, "json3": 1, "srv3": 2}
FORMAT_RANK_OTHER = 99
