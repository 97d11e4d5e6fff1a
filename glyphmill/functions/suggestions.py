"""Offline replacements of phrases, by language, in order; None where only a person or a model can improve the passage."""

from __future__ import annotations

# Fixed values.
SUGGESTIONS: dict[str, dict[str, str | None]] = {
    "en": {
        'comprehensive solution': None,
        'all your needs': None,
        'all-in-one solution': None,
        'empowering teams': None,
        'empowering you to': "so you can",
        'empowers you to': "lets you",
        'seamlessly integrate': "work with",
        'seamlessly integrates': "works with",
        'seamless integration': None,
        'intuitive interface': None,
        'user-friendly interface': None,
        'in just a few clicks': None,
        'in a matter of minutes': None,
        'get started in minutes': None,
        'at the core of everything': None,
        'everything you need in one place': None,
        'join thousands of': None,
        'trusted by thousands': None,
        'satisfied users': "users",
        'say goodbye to': None,
        'designed with you in mind': None,
        'built from the ground up': None,
        'the way it should be': None,
        'so you can focus on what matters': None,
        'focus on what truly matters': "focus on",
        'we believe that': "",
        'our mission is simple': None,
        'never looked back': None,
        'whatever you throw at it': None,
        'it just works': None,
        'and much more': None,
        'powerful yet simple': None,
        'simple yet powerful': None,
        'fast-paced digital': None,
        'digital landscape': None,
        'ever-changing landscape': None,
        'unlock the full potential': None,
        'full potential of your': None,
        'streamline your workflow': None,
        'streamline your workflows': None,
        'bridges the gap between': None,
        'not just about': None,
        'modern professional': None,
        "it's important to note": "", "it is important to note": "",
        "it is worth mentioning": "", "it should be noted that": "",
        "it is essential to understand": "", "one must consider": "",
        "generally speaking": "", "broadly speaking": "", "to some extent": "",
        "arguably": "",
        "in today's fast-paced world": "", "in today's digital age": "",
        "in the era of": "in", "in a world where": "when",
        "in this day and age": "now", "in the modern era": "now",
        "in the ever-evolving landscape": "in",
        "furthermore,": "", "moreover,": "", "additionally,": "also,",
        "nevertheless,": "still,", "consequently,": "so,",
        "subsequently,": "then,", "that being said": "still",
        "at its core": "basically",
        "in conclusion": "", "to summarize": "", "in summary": "",
        "to put it simply": "", "a key takeaway is": "",
        "from a broader perspective": "",
        "let's dive in": "", "let's explore": "", "let's unpack": "",
        "buckle up": "", "stay tuned": "", "here's the deal": "",
        "picture this": "", "imagine if": "", "what if i told you": "",
        "unlock the potential": "make the most", "unlock your potential": "do more",
        "seamless experience": "smooth experience", "look no further": "",
        "elevate your": "improve your", "unleash the power": "use the power",
        "game-changer": "big change", "at the end of the day": "",
        "boasts a": "has a", "plethora of": "many",
        "navigate the complexities": "deal with", "a testament to": "proof of",
        "whether you're": "", "dive into the world of": "look at",
        "stand the test of time": "last", "in the realm of": "in",
        "shed light on": "explain", "cutting-edge": "latest",
        "synergy": "working together", "paradigm shift": "major change",
        "low-hanging fruit": "easy wins", "move the needle": "make a difference",
        "boil the ocean": "do everything at once", "circle back": "come back to",
        "deep dive": "close look", "touch base": "check in",
        "value-add": "benefit", "win-win": "good for both sides",
        "bandwidth": "time",
        "is the new": "", "in the world of": "in",
        "delve": "look into", "underscore": "show", "pivotal": "key",
        "realm": "area", "harness": "use", "illuminate": "show",
        "facilitate": "help", "refine": "improve", "bolster": "strengthen",
        "differentiate": "set apart", "streamline": "simplify",
        "revolutionize": "change", "innovative": "new",
        "transformative": "far-reaching", "seamless": "smooth",
        "scalable": "able to grow", "comprehensive": "complete",
        "robust": "solid", "stellar": "excellent", "exceptional": "unusually good",
        "unparalleled": "unmatched", "dynamic": "changing", "intricate": "detailed",
        "nuanced": "subtle", "holistic": "whole", "paramount": "most important",
        "formidable": "hard to beat", "nimble": "quick", "supercharge": "speed up",
        "turbocharge": "speed up", "amplify": "increase", "embark": "start",
        "uncover": "find", "unveil": "show", "tailor": "adapt", "hone": "sharpen",
        "foster": "encourage", "myriad": "many", "countless": "many",
        "innumerable": "many", "substantial": "large", "testament": "proof",
        "tapestry": "mix", "indelible": "lasting", "invaluable": "very useful",
        "meticulous": "careful", "vibrant": "lively",
    },
    "uk": {
        'комплексне рішення': None,
        'для всіх ваших': None,
        'все в одному': None,
        'даючи змогу': "щоб",
        'дозволяючи вам': "щоб ви могли",
        'безшовно інтегру': None,
        'інтуїтивний інтерфейс': None,
        'зручний інтерфейс': None,
        'у кілька кліків': None,
        'за кілька хвилин': None,
        'почати роботу за': None,
        'основою всього, що ми': None,
        'все, що вам потрібно': None,
        'приєднуйтесь до тисяч': None,
        'задоволених користувачів': "користувачів",
        'забудьте про': None,
        'створено з думкою про': None,
        'ми переконані, що': "",
        'наша мета проста': None,
        'і багато іншого': None,
        'просте й водночас': None,
        'динамічному цифровому': None,
        'цифровому середовищі': None,
        'розкрийте повний потенціал': None,
        'повний потенціал': None,
        'оптимізувати робочі процеси': None,
        'оптимізували роботу': None,
        'не просто про': None,
        'сучасного професіонала': None,
        'передовому ai': None,
        'передові технології': None,
        'потужні технології': None,
        "у сучасному світі": "", "не є винятком": "", "варто зазначити": "",
        "важливо підкреслити": "", "зануримося": "",
        "розкрити потенціал": "використати сповна",
        "розкрийте потенціал": "використайте сповна",
        "на завершення": "", "підсумовуючи": "", "крім того,": "",
        "більше того,": "", "безсумнівно": "", "це свідчить про": "це показує",
        "надзвичайно важливо": "важливо", "широкий спектр": "багато",
        "справжня знахідка": "", "ідеальне рішення": "рішення",
        "у світі, де": "коли", "незалежно від того": "",
        "з кожним днем": "", "перш за все,": "", "невід'ємна частина": "частина",
        "інформаційний ландшафт": "медіа", "цифровий контент": "контент",
        "справжній феномен": "", "розумний вибір": "вибір",
        "оптимальне рішення": "рішення",
        "потреби сучасної аудиторії": "потреби аудиторії",
        "інноваційні рішення": "нові рішення",
        "максимальна ефективність": "ефективність",
        "більшість користувачів": "", "ось деякі з них": "",
        "особливо корисно": "корисно",
        "розмаїття": "різні", "оптимальний": "найкращий",
        "функціональність": "можливості", "феномен": "явище",
        "невід'ємно": "нерозривно", "інноваційність": "новизна",
        "ландшафт": "середовище", "аспект": "бік",
        "усвідомленість": "розуміння", "побоювання": "страх",
        "дискомфорт": "незручність", "новітність": "новизна",
        "адаптований": "пристосований", "захоплюючий": "цікавий",
        "сучасність": "сьогодення",
        "варто зауважити": "", "слід зазначити": "",
        "важливо зазначити": "", "необхідно розуміти": "", "загалом кажучи": "", "певною мірою": "",
        "у сучасному цифровому": "", "у наш час": "", "в епоху": "",
        "сьогодні, коли": "", "у світі, що швидко змінюється": "",
        "дедалі більше": "", "підсумовуючи вищесказане": "",
        "у підсумку,": "", "одним словом,": "",
        "розберімося": "", "уявіть собі": "", "а що, якщо": "",
        "залишайтеся з нами": "", "давайте розглянемо": "",
        "давайте зануримось": "",
        "не шукайте далі": None, "вивільніть потенціал": "використайте сповна",
        "нові можливості": None, "справжня революція": None,
        "проривне рішення": "рішення", "на новий рівень": None,
        "гнучке рішення": "рішення", "запорука успіху": None,
        "ключ до успіху": None, "низка переваг": "переваги",
        "чимало переваг": "переваги", "широкий вибір": "вибір",
        "справлятися з будь-яким": None, "будь-яке завдання": None,
        "зосередитися на важливому": None, "зосередитись на головному": None,
        "щоб ви могли зосередитися": None, "плавніший досвід": None,
        "інтуїтивніший досвід": None, "бездоганний досвід": None,
        "єдиний робочий простір": None, "усе необхідне": None,
        "жодних складнощів": None, "без зайвих зусиль": None,
        "лише кілька кроків": None, "у два кліки": None,
        "за лічені хвилини": None, "заощаджуйте час": None,
        "економте час": None, "підвищте продуктивність": None,
        "зробіть більше за менший час": None, "створено для того, щоб": "щоб",
        "розроблено, щоб": "щоб", "просто працює": None,
        "довіряють тисячі": None, "тисячі команд": None,
        "надійна безпека": "безпека", "змінює те, як": "змінює, як",
        "змінити те, як": "змінити, як",
        "інноваційний": "новий", "трансформаційний": "",
        "безшовний": "", "масштабований": "", "проривний": "",
        "передовий": "", "неперевершений": "", "багатогранний": "різнобічний",
        "всеосяжний": "повний", "революціонізувати": "змінити",
        "максимізувати": "збільшити", "нівелювати": "усунути",
        "уможливлює": "дає змогу", "покликаний": "має",
        "вирізняється": "відрізняється", "гармонійно": "",
    },
    "it": {
        'soluzione completa': None,
        'tutto in uno': None,
        'per tutte le tue': None,
        'si integra perfettamente': "funziona con",
        'interfaccia intuitiva': None,
        'in pochi clic': None,
        'in pochi minuti': None,
        'inizia in pochi minuti': None,
        'alla base di tutto': None,
        'unisciti a migliaia': None,
        'utenti soddisfatti': "utenti",
        'dimenticati di': None,
        'progettato pensando a': None,
        'crediamo che': "",
        'la nostra missione': None,
        'e molto altro': None,
        'potente ma semplice': None,
        'panorama digitale': None,
        'sblocca il pieno potenziale': None,
        'ottimizza il tuo flusso di lavoro': None,
        'non si tratta solo di': None,
        "nel mondo di oggi": "", "non fa eccezione": "",
        "è importante sottolineare": "", "vale la pena notare": "",
        "in conclusione": "", "riassumendo": "", "inoltre,": "",
        "per di più,": "", "senza dubbio": "", "un vero e proprio": "",
        "soluzione ideale": "soluzione", "ampia gamma": "molti",
        "esperienza senza precedenti": "esperienza nuova",
        "all'avanguardia": "aggiornato", "punto di svolta": "svolta",
        "immergiamoci": "", "che si tratti di": "",
        "in un mondo sempre più": "", "tuttavia,": "ma,",
        "nonostante ciò,": "eppure,", "probabilmente,": "forse,",
        "dinamico": "vivace", "efficiente": "rapido", "innovativo": "nuovo",
        "stimolante": "interessante", "efficienza": "resa",
        "agevolare": "aiutare", "massimizzare": "aumentare",
        "ottimizzazione": "miglioramento", "integrazione": "collegamento",
        "indagare": "esaminare", "rivoluzionario": "nuovo",
        "imprescindibile": "necessario", "fondamentale": "importante",
        "va notato che": "", "occorre considerare": "",
        "in linea di massima": "", "in una certa misura": "",
        "nell'era digitale": "", "in un mondo in continua evoluzione": "",
        "ai giorni nostri": "", "sempre più spesso": "spesso",
        "per riassumere": "", "in sintesi": "", "in definitiva,": "",
        "scopriamo insieme": "", "immagina di": "", "e se ti dicessi": "",
        "resta con noi": "", "vediamo insieme": "",
        "non cercare oltre": None, "libera il potenziale": "sfrutta",
        "nuove possibilità": None, "una vera rivoluzione": None,
        "soluzione all'avanguardia": "soluzione",
        "porta a un nuovo livello": None, "la chiave del successo": None,
        "una serie di vantaggi": "vantaggi", "ampia scelta": "scelta",
        "qualunque sia il tuo": None, "concentrarti su ciò che conta": None,
        "così puoi concentrarti": None, "esperienza più fluida": None,
        "esperienza impeccabile": None, "un unico spazio di lavoro": None,
        "tutto ciò di cui hai bisogno": None, "senza alcuno sforzo": None,
        "in pochi passaggi": None, "in due clic": None,
        "in pochissimo tempo": None, "risparmia tempo": None,
        "aumenta la produttività": None, "fai di più in meno tempo": None,
        "progettato per": None, "funziona e basta": None,
        "scelto da migliaia": None, "migliaia di team": None,
        "sicurezza affidabile": "sicurezza", "cambia il modo in cui": None,
        "trasformativo": "", "scalabile": "",
        "senza soluzione di continuità": "", "ineguagliabile": "",
        "poliedrico": "vario", "onnicomprensivo": "completo",
        "all'avanguardia": "", "consentendo di": "per",
        "permettendoti di": "per", "si distingue per": "",
    },
}
