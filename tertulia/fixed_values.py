"""Constants that decide results and must stay exactly as they are.

Nothing in this module is logic.  Word lists, masks, labels and code-point ranges are
kept together here so that every function and operator reads them from one place; each
public function also takes its own list as a parameter.
"""

# --- fixed values: senders, pseudonyms, masks ---------------------------------------
SYSTEM_SENDER = "Sistema"
PSEUDONYM_PREFIX = "Miembro_GDG_"
NAME_MASK = "[NOMBRE_OCULTO]"
NUMBER_MASK = "[NUMERO_OCULTO]"
MAIL_MASK = "[CORREO_OCULTO]"
UNKNOWN_DOMAIN = "Desconocido"

# --- fixed values: weekday labels, Monday first -------------------------------------
WEEKDAYS_ES = ["Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo"]

# --- fixed values: phrases that are never masked as person names --------------------
NAME_EXCEPTIONS = [
    "Hermosillo Community", "Nuevo Video", "Claude Code", "PyCharm", "Rider", "Pydantic",
    "Custom MCP Servers", "Gemini Multimodal", "Semicon Desert", "AiSalon",
    "Knowledge Graph", "Vibe Engineering", "Loop Engineering", "Google", "Antigravity",
    "Python", "Vibe Video Studio", "Taller Práctico", "Multi-Agentes de IA",
    "Refinar el Blueprint", "Resumen Técnico", "IDEs Agentic-first",
    "Workshop Especializado", "Auditoría de PRs",
    "Arquitectura y Desarrollo de Agentes de IA", "Analyst Agent", "Researcher Agent",
    "Critic & Refiner Agents", "Calendario Inteligente: Tabla", "Cloud Infra",
    "Custom Workflows", "Maura Health", "[LIVE CODING]", "Validar Atributos de Calidad",
    "Evaluación Continua", "Mención Honorífica",
    "Control de Comportamiento y Capacidades", "Senior Backend Developer",
    "Spec-Driven Development",
]

# --- fixed values: words that disqualify a person-name candidate --------------------
BLOCKED_NAME_WORDS = [
    "Pfff", "Rigor", "Aprenderás", "Aprenderas", "Explora", "Solo", "Caleño", "Fork",
    "Adicional", "Comparte", "Inglés", "Miércoles", "H2H", "Coding", "Sistemas", "Zonas",
    "Mucho", "daré", "Skills", "Fecha", "Captura", "Justificar", "Patrones", "Workshop",
    "Ingles", "Miercoles",
]

# --- fixed values: chat words removed next to the Spanish stop words ----------------
CHAT_STOP_WORDS = [
    "multimedia", "omitido", "numero", "oculto", "cambio", "toca", "obtener", "mas",
    "informacion", "seguridad", "unio", "enlace", "grupo", "comunidad", "sticker",
    "audio", "codigo", "nombre", "añadio", "si", "link", "hola", "dia", "solo", "aqui",
    "edito", "mensaje", "jaja", "jajaja", "jejeje", "utm", "source", "medium",
    "campaign", "content", "sourceshareutm", "http", "https", "www",
]

# --- fixed values: stop words of the usual word-cloud picture (apostrophe forms left
# out: a cleaned token never holds an apostrophe) ------------------------------------
CLOUD_STOP_WORDS = (
    "a about above after again against all also am an and any are as at be because been "
    "before being below between both but by can cannot com could did do does doing down "
    "during each else ever few for from further get had has have having he hence her here "
    "hers herself him himself his how however http i if in into is it its itself just k "
    "like me more most my myself no nor not of off on once only or other otherwise ought "
    "our ours ourselves out over own r same shall she should since so some such than that "
    "the their theirs them themselves then there therefore these they this those through "
    "to too under until up very was we were what when where which while who whom why with "
    "would www you your yours yourself yourselves"
).split()

# --- fixed values: texts read as missing by the usual CSV reader of data frames -----
CSV_MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- fixed values: white space as str.split() sees it -------------------------------
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: code points with the Unicode property Emoji (hexadecimal, without
# digits, '#', '*' and regional indicators, which only count in sequences) -----------
EMOJI_RANGES = (
    "A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 "
    "23F8-23FA 24C2 25AA-25AB 25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D "
    "2620 2622-2623 2626 262A 262E-262F 2638-263A 2640 2642 2648-2653 265F-2660 2663 "
    "2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C 26A0-26A1 26A7 26AA-26AB "
    "26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5 "
    "26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 271D 2721 2728 2733-2734 2744 "
    "2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 "
    "2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E "
    "1F191-1F19A 1F201-1F202 1F21A 1F22F 1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393 "
    "1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E "
    "1F550-1F567 1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 "
    "1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF "
    "1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D7 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC "
    "1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA70-1FA7C "
    "1FA80-1FA89 1FA8F-1FAC6 1FACE-1FADC 1FADF-1FAE9 1FAF0-1FAF8"
)
