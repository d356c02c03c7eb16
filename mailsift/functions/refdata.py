"""Word lists and tables that results depend on, as text in natural order."""

SUFFIXES = """
co.uk org.uk ac.uk gov.uk me.uk net.uk sch.uk co.in net.in org.in gov.in ac.in edu.in firm.in gen.in ind.in
com.au net.au org.au edu.au gov.au id.au co.nz net.nz org.nz govt.nz ac.nz com.br net.br org.br gov.br
com.cn net.cn org.cn gov.cn edu.cn co.jp ne.jp or.jp ac.jp go.jp co.kr or.kr ne.kr go.kr
com.sg com.hk com.tw com.my com.ph com.vn com.pk com.bd com.tr com.mx com.ar com.co com.pe com.ve com.ec com.uy com.do
com.sa com.eg com.ng com.gh com.ua com.pl com.ru org.ru net.ru co.za co.ke co.tz co.ug co.il co.th co.id
github.io gitlab.io pages.dev workers.dev r2.dev herokuapp.com azurewebsites.net cloudfront.net amazonaws.com
firebaseapp.com web.app netlify.app vercel.app glitch.me repl.co onrender.com surge.sh ngrok.io ngrok-free.app
trycloudflare.com 000webhostapp.com weebly.com wixsite.com blogspot.com
""".split()

FREE_HOSTING = """
github.io gitlab.io pages.dev workers.dev r2.dev herokuapp.com azurewebsites.net firebaseapp.com web.app netlify.app
vercel.app glitch.me repl.co onrender.com surge.sh ngrok.io ngrok-free.app trycloudflare.com 000webhostapp.com weebly.com
wixsite.com blogspot.com duckdns.org no-ip.org hopto.org serveo.net localtunnel.me
""".split()

SHORTENERS = """
bit.ly tinyurl.com goo.gl t.co ow.ly is.gd buff.ly rebrand.ly cutt.ly shorturl.at tiny.cc rb.gy s.id lnkd.in t.ly bl.ink
shorte.st adf.ly soo.gd u.to clck.ru v.gd qr.ae x.co po.st mcaf.ee db.tt q.gs
""".split()

RISKY_TLDS = """
tk ml ga cf gq xyz top work click link live icu buzz rest monster bar cyou sbs cfd quest mom lol zip mov review country kim
science party gdn loan download racing win bid stream date faith cricket accountant men trade webcam pw su cc ru cn info biz
online site space website fun store shop today world life email support help center autos beauty hair skin
""".split()

BRANDS = """
paypal microsoft office365 office outlook onedrive sharepoint teams azure apple icloud itunes appleid amazon aws google gmail
drive docs youtube netflix spotify facebook instagram whatsapp meta linkedin twitter x adobe dropbox docusign zoom slack
github gitlab atlassian jira chase wellsfargo bankofamerica citibank americanexpress amex hsbc barclays santander lloyds
natwest revolut wise hdfc icici sbi axis kotak pnb yesbank idfc rbl bandhan indusind paytm phonepe googlepay bhim upi npci
rbi incometax gst uidai aadhaar dhl fedex ups usps bluedart delhivery dtdc ekart irs hmrc gov nhs medicare coinbase binance
metamask kraken blockchain ledger trezor steam epicgames roblox discord telegram signal flipkart myntra swiggy zomato ola
uber irctc
""".split()

BRAND_DOMAINS = """
paypal.com microsoft.com office.com outlook.com apple.com icloud.com amazon.com google.com gmail.com netflix.com facebook.com
instagram.com linkedin.com whatsapp.com adobe.com dropbox.com docusign.com zoom.us github.com dhl.com fedex.com ups.com
hdfcbank.com icicibank.com onlinesbi.sbi axisbank.com kotak.com paytm.com phonepe.com irctc.co.in flipkart.com coinbase.com
binance.com chase.com hsbc.com
""".split()

PATH_TOKENS = """
login signin sign-in log-in logon auth authenticate verify verification validate confirm confirmation secure security update
updating account accounts recover recovery reset unlock unblock suspended limited restricted billing payment invoice refund
reward bonus prize claim gift wallet webscr cmd session token otp mfa 2fa credential password passwd pwd customer support
helpdesk service portal myaccount id user
""".split()

REDIRECT_PARAMS = "url u redirect redirect_uri redirect_url next target dest destination return returnurl return_url continue goto link out r q to forward rurl ref".split()

FREEMAIL = """
gmail.com googlemail.com yahoo.com yahoo.co.in yahoo.co.uk ymail.com hotmail.com outlook.com live.com msn.com aol.com icloud.com
me.com mac.com protonmail.com proton.me tutanota.com zoho.com gmx.com gmx.net mail.com mail.ru yandex.com yandex.ru
rediffmail.com inbox.com fastmail.com hushmail.com tempmail.com guerrillamail.com 10minutemail.com mailinator.com yopmail.com
sharklasers.com throwawaymail.com
""".split()

DISPOSABLE = """
tempmail.com guerrillamail.com 10minutemail.com mailinator.com yopmail.com sharklasers.com throwawaymail.com trashmail.com
getnada.com dispostable.com maildrop.cc temp-mail.org fakeinbox.com mintemail.com spamgourmet.com
""".split()

LEXICONS = {
    "urgency": "urgent urgently immediately immediate asap hurry quick quickly instant instantly today tonight expire expires expiring expired deadline final promptly prompt now soon shortly overdue pending rush critical".split(),
    "threat": "suspended suspension terminated termination closed closure blocked block restricted restriction locked lock disabled deactivate deactivated deactivation penalty fine legal lawsuit prosecution police unauthorized unauthorised breach compromised hacked fraud fraudulent violation violate warning alert failure failed problem issue risk danger delete deletion permanently consequences".split(),
    "credential": "password passwords passcode pin otp credential credentials username userid login log signin sign authenticate authentication verify verification validate validation confirm confirmation reactivate reset unlock mfa 2fa token security secure account accounts profile identity kyc aadhaar ssn dob".split(),
    "financial": "payment payments invoice invoices billing bill refund refunds transaction transactions transfer wire deposit withdraw withdrawal balance credit debit card bank banking iban swift upi ifsc salary payroll bonus commission tax gst customs duty fee charge overdue outstanding settle crypto bitcoin btc eth wallet usdt".split(),
    "reward": "congratulations congrats winner won win prize reward rewards gift voucher coupon cashback lottery jackpot selected lucky free exclusive offer discount claim redeem eligible qualify".split(),
    "authority": "administrator admin helpdesk support team department official compliance audit auditor director ceo cfo manager hr payroll it security government ministry authority bureau commission notice mandate policy regulation regulatory required mandatory".split(),
    "secrecy": "confidential confidentially private privately discreet discreetly secret secretly quietly between nobody anyone disclose sensitive internal restricted".split(),
    "action": "click clicking tap press follow visit open download attach attached attachment review check update upgrade install enable submit complete fill provide send reply respond call contact".split(),
}

URGENCY_PHRASES = [
    "act now", "right away", "as soon as possible", "within 24 hours", "within 48 hours", "last chance", "final notice", "final warning", "time sensitive", "limited time", "do not delay",
    "before it is too late", "immediate action", "immediate attention", "action required", "response required", "avoid suspension", "failure to comply", "your account will be", "will be permanently", "expires today",
]

GREETINGS = [
    "dear customer", "dear user", "dear client", "dear member", "dear sir", "dear madam", "dear sir/madam", "dear account holder", "dear valued", "dear subscriber", "dear friend", "hello user", "hello customer",
    "attention customer", "to whom it may concern", "dear email user",
]

EXECUTABLE = "exe scr com pif bat cmd vbs vbe js jse wsf wsh ps1 psm1 msi msp hta cpl jar apk app dmg lnk reg inf iso img vhd chm gadget".split()
MACRO = "docm xlsm pptm dotm xltm potm xlam ppam".split()
ARCHIVE = "zip rar 7z tar gz bz2 xz cab ace arj z lzh".split()
DOCUMENT = "pdf doc docx xls xlsx ppt pptx rtf odt ods odp html htm".split()

#: Letters and signs that look like the ASCII ones below them.
LOOKALIKES = "авсԁеѕһіјкмнорԛгтухѡцАВСЕНІЈКМОРЅТУХαβεικνορτυχγϲѵΑΒΕΖΗΙΚΜΝΟΡΤΧΥѐǃɑɡɩʏʜᴀᴄᴅᴇᴏᴘᴛ‐‑‒–—―−․。｡﹒／⁄∕：；＠＂＇‚，“”‘’＿－\u00a0\u2007\u202f\u2009\u3000"
LOOKED_LIKE = "abcdeshijkmhopqrtyxwuABCEHIJKMOPSTYXabeikvoptuxycvABEZHIKMNOPTXYe!agiyhacdeopt-------....///:;@\"',,\"\"''_-     "
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u180e\u00ad"
BIDI = "‪‫‬‭‮⁦⁧⁨⁩"
LEET, LETTERS = "013457$@", "oleastsa"

#: Rules of the checklist score: id, weight, column, least value. The intercept is the score without any.
INTERCEPT = -2.2
RULES = [
    ("R01", 1.5, "hdr_display_brand_domain_mismatch", 0.5), ("R02", 1.7, "hdr_is_lookalike", 0.5), ("R03", 0.9, "hdr_replyto_domain_mismatch", 0.5), ("R04", 0.5, "hdr_returnpath_domain_mismatch", 0.5),
    ("R05", 0.7, "hdr_spf_fail", 0.5), ("R06", 0.8, "hdr_dmarc_fail", 0.5), ("R07", 1.1, "hdr_sender_high_risk_tld", 0.5), ("R08", 1.4, "hdr_sender_disposable", 0.5),
    ("R09", 1.8, "link_any_brand_impersonation", 0.5), ("R10", 1.6, "link_text_shows_url_mismatch", 0.5), ("R11", 1.3, "link_any_ip_host", 0.5), ("R12", 0.7, "link_any_shortener", 0.5),
    ("R13", 0.9, "link_any_free_hosting", 0.5), ("R14", 0.8, "link_any_redirect_param", 0.5), ("R15", 1.0, "link_any_punycode", 0.5), ("R16", 0.8, "body_lex_credential", 3.0),
    ("R17", 0.7, "body_urgency_phrases", 1.0), ("R18", 0.8, "body_lex_threat", 3.0), ("R19", 0.6, "body_generic_greeting", 1.0), ("R20", 1.9, "html_password_input", 0.5),
    ("R21", 0.7, "html_hidden_style_count", 1.0), ("R22", 2.0, "att_executable", 1.0), ("R23", 1.4, "att_macro_enabled", 1.0), ("R24", 2.0, "att_double_extension", 1.0),
    ("R25", 1.2, "obf_zero_width_count", 1.0), ("R26", 1.5, "obf_mixed_script_words", 1.0), ("R27", 0.5, "subj_all_caps_words", 2.0), ("R28", 0.7, "body_lex_reward", 3.0),
    ("R29", -0.9, "hdr_auth_score", 0.99), ("R30", -1.0, "link_official_brand_ratio", 0.99), ("R31", -0.5, "body_unsubscribe_present", 0.5), ("R32", -1.2, "beh_relationship_strength", 0.5),
    ("R33", -0.7, "beh_domain_age_days", 730.0), ("R34", 1.2, "beh_young_domain", 0.5), ("R35", 0.9, "beh_campaign_shape", 0.4), ("R36", 0.8, "beh_display_name_reuse", 0.5), ("R37", 1.0, "beh_domain_reported", 0.5),
]

#: Click-time weights of URL signs; two or more path tokens add PATH_WEIGHT, a brand's own domain takes OFFICIAL off, no HTTPS adds PLAIN.
CLICK_WEIGHTS = {
    "brand_impersonation": 0.34, "is_ip_host": 0.20, "mixed_script_host": 0.15, "high_risk_tld": 0.14, "free_hosting": 0.12, "is_punycode": 0.12, "has_userinfo": 0.12,
    "has_at_symbol": 0.10, "is_shortener": 0.08, "has_redirect_param": 0.08, "deep_subdomain": 0.07, "nonstandard_port": 0.06, "double_slash_in_path": 0.05,
}
PATH_WEIGHT, OFFICIAL, PLAIN = 0.08, 0.35, 0.04

#: Words and signs that message features count.
FIRST_PLURAL, SECOND_PERSON = "we our us ours".split(), "you your yours yourself".split()
NO_REPLY = ("noreply", "no-reply", "donotreply")
CURRENCY = r"(?i)[$£€₹¥]|\b(?:usd|eur|gbp|inr|rs\.?|dollars?|rupees?|euros?)\b"
NUMBER = r"\b[0-9][0-9,]*(?:\.[0-9]+)?\b"
GREETED = r"(?i)^\s*(?:dear|hello|hi|greetings|good\s+(?:morning|afternoon|evening))"
IMPERATIVE = r"(?im)^[^\S\n]*(?:click|verify|confirm|update|download|call|reply|login|sign|open|submit|act|do not|don't)\b"
SIGNED = r"(?i)regards|sincerely|thanks|best wishes|yours truly"
UNSUBSCRIBE = r"(?i)unsubscribe|opt.?out|manage preferences"
PHONE = r"(?:\+[0-9]{1,3}[\s-]?)?(?:[0-9][\s-]?){8,13}[0-9]"
MAIL_ADDRESS = r"[\w.\-+]+@[\w.\-]+\.\w+"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}]"
HIDDEN_STYLE = r"(?i)display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0|opacity\s*:\s*0|width\s*:\s*0|height\s*:\s*0|color\s*:\s*#?f{3,6}\b"
ENTITY = r"&(?:#x?[0-9a-fA-F]+|[a-zA-Z]{2,8});"
PASSWORD_INPUT = r"(?i)<input[^>]*type\s*=\s*[\"']?password"

#: What analysts read for a feature; {v} is its value.
FEATURE_PHRASES = {
    "hdr_display_brand_domain_mismatch": "Display name claims a brand the sending domain does not own",
    "hdr_is_lookalike": "Sending domain is a near-miss imitation of a well-known domain",
    "hdr_lookalike_distance": "Sending domain is {v} character edits from a well-known domain",
    "hdr_replyto_domain_mismatch": "Replies would go to a different domain than the sender",
    "hdr_returnpath_domain_mismatch": "Envelope sender does not match the From header",
    "hdr_spf_fail": "SPF check failed",
    "hdr_dmarc_fail": "DMARC check failed",
    "hdr_dkim_fail": "DKIM signature did not verify",
    "hdr_auth_score": "{v} of the three authentication checks passed",
    "hdr_sender_high_risk_tld": "Sending domain uses a top-level domain with high abuse rates",
    "hdr_sender_disposable": "Sending domain is a disposable mail provider",
    "hdr_sender_freemail": "Sent from a free consumer mail provider",
    "hdr_sender_free_hosting": "Sending domain is on free hosting infrastructure",
    "hdr_local_is_noreply": "Sent from a no-reply style mailbox",
    "link_any_brand_impersonation": "A link impersonates a brand it does not belong to",
    "link_any_brand_squat": "A link's domain contains a brand name it does not own",
    "link_any_brand_lookalike": "A link's domain is a typosquat of a real brand domain",
    "link_text_shows_url_mismatch": "A link's visible text points somewhere other than its destination",
    "link_text_href_mismatch": "Link text names a brand the destination does not belong to",
    "link_any_ip_host": "A link points at a bare IP address instead of a hostname",
    "link_any_shortener": "A link is hidden behind a URL shortener",
    "link_any_free_hosting": "A link is hosted on free, anonymous infrastructure",
    "link_any_redirect_param": "A link redirects through another site",
    "link_any_punycode": "A link uses an internationalised domain that can imitate ASCII",
    "link_count": "Message contains {v} link(s)",
    "link_unique_domains": "Links point at {v} distinct domains",
    "url_high_risk_tld__max": "A link uses a high-abuse top-level domain",
    "url_num_subdomains__max": "A link's host is padded with {v} subdomain levels",
    "url_suspicious_token_count__max": "A link's path contains {v} credential-page keyword(s)",
    "url_host_entropy__max": "A link's hostname looks machine-generated",
    "link_official_brand_ratio": "Links point at genuine brand domains",
    "body_lex_credential": "Body asks for credentials ({v} references)",
    "body_lex_threat": "Body threatens consequences ({v} references)",
    "body_lex_urgency": "Body applies time pressure ({v} references)",
    "body_lex_financial": "Body concerns money or payment ({v} references)",
    "body_lex_reward": "Body offers a reward or prize ({v} references)",
    "body_lex_authority": "Body invokes authority ({v} references)",
    "body_lex_secrecy": "Body asks for secrecy ({v} references)",
    "body_urgency_phrases": "Body uses {v} explicit deadline phrase(s)",
    "body_generic_greeting": "Generic greeting rather than the recipient's name",
    "body_imperative_starts": "{v} line(s) start with a direct instruction",
    "body_unsubscribe_present": "Message carries an unsubscribe footer",
    "body_signature_present": "Message has a conventional sign-off",
    "subj_urgency_phrases": "Subject applies time pressure",
    "subj_all_caps_words": "Subject shouts in capitals ({v} words)",
    "subj_exclamations": "Subject uses {v} exclamation mark(s)",
    "html_password_input": "HTML contains a password entry field",
    "html_form_count": "HTML contains {v} form(s)",
    "html_hidden_style_count": "HTML contains {v} hidden or zero-size element(s)",
    "html_image_only": "Message body is an image with almost no text",
    "html_entity_density": "HTML uses an unusual density of character entities",
    "att_executable": "{v} executable attachment(s)",
    "att_macro_enabled": "{v} macro-enabled document attachment(s)",
    "att_double_extension": "{v} attachment(s) use a double extension",
    "att_archive": "{v} archive attachment(s)",
    "obf_zero_width_count": "Text contains {v} invisible character(s)",
    "obf_mixed_script_words": "{v} word(s) mix character scripts (homoglyph obfuscation)",
    "obf_confusable_ratio": "Text contains look-alike characters from other alphabets",
    "obf_leet_tokens": "{v} word(s) use digit-for-letter substitution",
    "obf_separated_tokens": "{v} word(s) are split with punctuation or spaces",
    "obf_norm_edit_ratio": "Text changed substantially under normalisation",
    "beh_sender_first_seen": "First message ever received from this sender",
    "beh_relationship_strength": "Established correspondence history with this sender",
    "beh_prior_messages": "{v} previous message(s) from this sender",
    "beh_young_domain": "Sending domain was registered recently",
    "beh_domain_age_days": "Sending domain is {v} days old",
    "beh_off_hours": "Received outside normal working hours",
    "beh_campaign_shape": "Arrived as part of a burst from an unfamiliar sender",
    "beh_burst_count_1h": "{v} message(s) from this domain in the last hour",
    "beh_display_name_reuse": "This display name has been used by several different addresses",
    "beh_domain_reported": "Users have previously reported this sending domain",
    "beh_mass_mailing": "Sent to a large recipient list",
    "beh_trust_deficit": "Overall unearned-trust score {v}",
    "beh_cold_contact_with_ask": "An unknown sender is making a request",
    "beh_young_domain_and_ask": "A newly registered domain is making a request",
    "beh_context_available": "Sender history was available for this assessment",
}

#: What stands for the parts of other features' names, replaced in this order.
FEATURE_FAMILIES = (
    ("__max", " (worst link)"), ("__mean", " (average link)"), ("hdr_", "header: "), ("body_", "body: "), ("subj_", "subject: "), ("html_", "HTML: "), ("att_", "attachment: "),
    ("beh_", "behaviour: "), ("url_", "link: "), ("link_", "link: "), ("obf_", "obfuscation: "), ("_", " "),
)
