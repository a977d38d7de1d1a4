"""Wording of the findings: (description, recommendation) per rule.

Texts are this project's own. `{}` marks where a column value goes in.
"""

MESSAGES = {
    "reply_to": (
        "Answers to this mail would leave the domain it claims to come from.",
        "Confirm who the sender is before you reply.",
    ),
    "return_path": (
        "Bounces go to another domain than the visible sender, so another mail system handed it in.",
        "Be wary: the visible sender may be made up.",
    ),
    "no_message_id": (
        "Mail servers stamp a Message-ID on what they send; this mail has none.",
        "The mail may have been put together by hand.",
    ),
    "message_id": (
        "The Message-ID was issued by a domain unrelated to the visible sender.",
        "Weak alone; read it together with the other findings.",
    ),
    "bad_date": (
        "The Date header is absent or cannot be read as a date.",
        "Regular mail servers write a valid Date.",
    ),
    "display_name": (
        "The display name mentions '{}' while the mail was sent from '{}', which does not.",
        "Look at the address itself, not at the name shown.",
    ),
    "brand_free_mail": (
        "A brand is named in the display name, yet the mail came from the free provider {}.",
        "Companies write from their own domains.",
    ),
    "address_in_name": (
        "An e-mail address is shown as the sender's name, hiding the real one.",
        "Read the real From address.",
    ),
    "auth_missing": (
        "The receiving server left no record of SPF, DKIM or DMARC checks.",
        "Nothing vouches for the sender; take care.",
    ),
    "spf_fail": (
        "SPF says this server may not send for the domain.",
        "Treat the sender address as forged.",
    ),
    "spf_softfail": (
        "SPF says this server probably should not send for the domain.",
        "Take care: the sender is not clearly authorized.",
    ),
    "spf_none": (
        "The domain publishes no SPF policy.",
        "The sending server cannot be checked.",
    ),
    "dkim_fail": (
        "The DKIM signature does not verify: forged, or changed on the way.",
        "Do not rely on what this mail says.",
    ),
    "dkim_none": (
        "The mail carries no DKIM signature.",
        "Whether it was changed on the way cannot be checked.",
    ),
    "dmarc_fail": (
        "The mail breaks the DMARC policy of the domain it names.",
        "The mail most likely has another origin.",
    ),
    "dmarc_none": (
        "The domain publishes no DMARC policy.",
        "The domain gives receivers no rule to enforce.",
    ),
    "auth_multi": (
        "SPF and DMARC fail together, which points at a forged sender.",
        "Do not act on this mail.",
    ),
    "link_mismatch": (
        "The link shows one domain and leads to another.",
        "Leave the link alone.",
    ),
    "link_ip": (
        "The link leads to a bare IP address, not to a named site.",
        "Leave links to bare addresses alone.",
    ),
    "link_short": (
        "A shortening service hides where the link leads.",
        "Find out the target before following it.",
    ),
    "link_http": (
        "The link is not encrypted.",
        "Prefer sites that use HTTPS.",
    ),
    "link_punycode": (
        "The host name is punycode and may look like another name when shown.",
        "Check the name letter by letter.",
    ),
    "link_subdomains": (
        "The host name has {} dots, which can bury the domain that owns it.",
        "Read the last two labels of the host name.",
    ),
    "link_keyword": (
        "The address of the page contains '{}'.",
        "Check the address before typing anything there.",
    ),
    "typosquat": (
        "'{}' is {} edit(s) away from {} ({}).",
        "Make sure this really is {}.",
    ),
    "char_substitution": (
        "'{}' swaps letters for look-alikes to resemble {} ({}).",
        "Assume this is not {}.",
    ),
    "brand_keyword": (
        "'{}' joins the brand '{}' with a word common in lures.",
        "Check that {} owns this domain.",
    ),
    "double_extension": (
        "'{}' carries several extensions ({}), a way to pass a program off as a document.",
        "Do not open the file.",
    ),
    "suspicious_type": (
        "'{}' is of a type ({}) that can do harm when opened.",
        "Open it only if you know where it came from.",
    ),
    "hidden_extension": (
        "'{}' hides the risky extension {} before its last one.",
        "Do not open the file.",
    ),
    "mime_mismatch": (
        "Declared as '{}' but named '{}'.",
        "The type may be disguised.",
    ),
    "multi_signal": (
        "{} kinds of lure wording occur together: {}.",
        "Treat the mail as a likely phishing attempt.",
    ),
}

SIGNAL_MESSAGES = {
    "urgency": (
        "The wording rushes the reader.",
        "Take your time; real deadlines are rarely set by mail alone.",
    ),
    "account_suspension": (
        "The wording threatens loss of an account.",
        "Go to the provider's own site instead of following the mail.",
    ),
    "credential_request": (
        "The wording asks for credentials.",
        "Never give credentials because a mail asks.",
    ),
    "payment_request": (
        "The wording asks for money or points to an invoice.",
        "Confirm payments by another channel.",
    ),
    "gift_card": (
        "The wording asks for gift cards.",
        "Gift cards asked for by mail are a scam, whoever signs.",
    ),
    "attachment_request": (
        "The wording urges opening a file or enabling macros.",
        "Open files only from senders you are sure of.",
    ),
    "link_click_request": (
        "The wording urges following a link.",
        "Look at the target before following it.",
    ),
    "impersonation_language": (
        "The wording speaks for a department.",
        "Call the department on a number you already have.",
    ),
}
DEFAULT_SIGNAL_MESSAGE = ("Wording typical of lures.", "Take care.")
