"""Weighted vocabulary of the URL filter as data: terms by category. Terms are whole runs of letters and digits; inflections are terms of their own.

``STRICT`` terms decide alone. Of the others, ``STRONG`` ones have weight 2 and ``WEAK`` ones, which are common in clean addresses too, weight 1.
"""

from __future__ import annotations

STRICT: dict[str, str] = {
    "adult": "porn porno porns pornhub pornstar pornstars xxx xxxvideos hentai milf milfs camgirl camgirls sexcam sexcams livesex gangbang blowjob blowjobs handjob cumshot cumshots creampie bukkake bdsm upskirt "
    "nsfw redtube xvideos xhamster youporn brazzers deepthroat fetishcam shemale shemales escorts escort callgirl callgirls stripchat chaturbate sextube",
    "piracy": "warez keygen keygens crackz serialz torrentz thepiratebay piratebay nulled fullcrack moviez appz",
    "pharmacy": "viagra cialis levitra kamagra tramadol xanax ambien phentermine oxycontin sildenafil tadalafil",
    "gambling": "pokerstars partypoker casinoonline onlinecasino slotmachine slotmachines betway sportsbook sportsbooks",
    "fraud": "phishing carding cvvshop fullz ponzi paydayloan paydayloans",
    "malware": "botnet botnets ransomware keylogger keyloggers malwarez exploitkit",
}
STRONG: dict[str, str] = {
    "adult": "sex sexy sexo sexual sexuals adult adults nude nudes nudity naked erotic erotica erotik fetish fetishes webcam webcams strip stripper strippers striptease lingerie swinger swingers hooker hookers "
    "hookup hookups horny kinky lesbian lesbians busty boobs tits ass babes cam cams voyeur orgy",
    "gambling": "casino casinos poker bet bets betting gamble gambler gambling slots jackpot jackpots roulette blackjack baccarat bingo lottery lotto wager wagers bookmaker bookmakers bookie",
    "pharmacy": "pill pills pharmacy pharmacies pharma meds rx steroid steroids painkiller painkillers diet weightloss slimming enlargement prescription",
    "piracy": "crack cracks cracked serials torrent torrents hack hacks hacked hacking cheats leaked leak leaks activator pirated pirate mp3z iso",
    "dating": "dating singles flirt flirts flirting hotgirls brides milfdating matchmaking",
    "finance": "loan loans payday forex bitcoin crypto binary refinance mortgage mortgages credit debt insurance",
    "spam": "spam spammer spams spamming linkfarm backlinks backlink doorway clickbait popup popups adserver adservers ads adware tracker trackers spyware malware phish scam scams replica replicas counterfeit",
}
WEAK: dict[str, str] = {
    "lure": "free cheap cheapest discount discounts bonus bonuses win winner winners winning prize prizes deal deals offer offers promo promos coupon coupons hot best top instant fast easy buy order sale sales clearance "
    "bargain bargains guaranteed unlimited exclusive vip gift gifts cash money earn earnings rich profit profits income",
    "young": "girl girls teen teens babe boy boys wife wives mature amateur amateurs couples",
    "media": "video videos pics pictures photos movie movies clips tube stream streaming live chat chats download downloads full gallery galleries",
    "trade": "farm farms track tracking click clicks banner banners affiliate affiliates traffic redirect redir promo pop code codes key keys generator unlock unlocked mod apk",
    "health": "health drug drugs generic online shop store detox burn burner fat muscle",
}
STRICT_WEIGHT, STRONG_WEIGHT, WEAK_WEIGHT = 4, 2, 1
#: Different soft terms of this weight together, at least two of them, reject a URL.
SOFT_NEEDED, SOFT_WEIGHT = 2, 3


def terms(of: dict[str, str]) -> tuple[str, ...]:
    return tuple(sorted({t for line in of.values() for t in line.split()}))


#: term: weight
WEIGHTS: dict[str, int] = {t: WEAK_WEIGHT for t in terms(WEAK)} | {t: STRONG_WEIGHT for t in terms(STRONG)} | {t: STRICT_WEIGHT for t in terms(STRICT)}
