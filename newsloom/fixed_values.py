"""Lists, thresholds, patterns and texts that define the results.

Nothing here is logic.  Every value below is data that has to be the same for
two runs (or two systems) to give the same answer.
"""

# --- page extraction -------------------------------------------------------

# Containers tried in this order: (tag, attribute, operator, value).
SELECTORS = (
    ("article", None, None, None),
    ("main", None, None, None),
    ("div", "cls", "contains", "post-content"),
    ("div", "cls", "contains", "entry-content"),
    ("div", "cls", "contains", "article-body"),
    ("div", "id", "equals", "content"),
)
SELECTOR_MIN_BYTES = 500
SCORED_TAGS = ("div", "section", "article")
SCORE_DROP_TAGS = ("script", "style", "form", "iframe", "noscript")
SCORE_MIN_BYTES = 100
MIN_SCORE = 10.0
LINK_DENSITY_LIMIT = 0.3
GOOD_NAME = r"(?i)(content|article|body|main)"
BAD_NAME = r"(?i)(sidebar|menu|nav|footer|ad)"

CLEAN_DROP_TAGS = ("aside", "nav", "footer", "header")
CLEAN_DROP_IDS = (
    "about-the-author", "author-bio", "post-author", "author-box", "article-author",
    "comments", "respond", "comment-form", "comment-list",
    "related-posts", "you-may-also-like", "similar-posts",
    "share-buttons", "social-share", "newsletter-signup", "subscribe-form",
    "ad-container", "ad-wrapper", "ad-slot", "advertisement",
    "sidebar", "widget-area", "navigation", "breadcrumb",
    "post-meta", "post-footer", "entry-footer", "article-footer",
    "before-comments", "after-content", "post-navigation", "pagination",
    "rating-container", "review-box", "score-card",
    "menu", "navbar", "header-nav", "footer-nav", "mobile-menu",
    "top-bar", "sticky-header", "fixed-header", "floating-menu",
)
CLEAN_DROP_CLASSES = (
    "author-box", "author-bio", "about-author", "post-author", "article-author",
    "comments-area", "comment-respond", "comment-form", "comment-list",
    "related-posts", "related-articles", "you-may-also-like", "similar-posts",
    "post-related", "post-primary-tag-related",
    "share-buttons", "social-share", "share-this",
    "newsletter", "newsletter-signup", "subscribe", "subscribe-form", "email-signup",
    "ad-container", "ad-wrapper", "ad-slot", "advertisement", "sponsored", "promoted",
    "sidebar", "widget", "sidebar-widget", "widget-area", "secondary", "tertiary",
    "navigation", "post-navigation", "breadcrumb", "breadcrumbs", "yoast-breadcrumb",
    "post-meta", "entry-meta", "article-meta",
    "post-footer", "entry-footer", "article-footer",
    "before-comments", "after-content", "pagination", "page-nav",
    "rating", "movie-rating", "review-box", "score", "vote", "imdb-rating",
    "rotten-tomatoes", "metascore",
    "menu", "navbar", "nav-bar", "header-nav", "footer-nav", "mobile-menu",
    "top-bar", "sticky-header", "fixed-header", "floating-menu",
    "advertisement-banner", "ad-banner", "sponsored-content",
    "related-content", "recommended-posts", "suggested-articles",
    "popup", "modal", "overlay", "lightbox",
    "cookie-notice", "cookie-banner", "gdpr-banner",
)

CHARSET_PATTERN = r"""(?i)<meta[^>]+charset=["']?([^"'>]+)["']?"""
TITLE_PATTERN = r"(?is)<title[^>]*>(.*?)</title>"
OG_TITLE_PATTERN = r"""(?i)<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']+)["']"""
OG_IMAGE_PATTERN = r"""(?i)<meta[^>]+property=["']og:image["'][^>]+content=["']([^"']+)["']"""
DESCRIPTION_PATTERN = r"""(?i)<meta[^>]+name=["']description["'][^>]+content=["']([^"']+)["']"""
IMG_SRC_PATTERN = r"""(?i)<img[^>]+src=["']([^"']+)["']"""
IMAGE_CLASS = "wp-image-"
JSONLD_PATTERN = r"""(?is)<script type=["']application/ld\+json["']>(.*?)</script>"""
IMAGE_PATH_PATTERN = r"(?i)\.(jpg|jpeg|png|gif|webp|svg)$"
STYLE_ATTR_PATTERN = r"""(?i)\s+style=["'][^"']*["']"""
HANDLER_ATTR_PATTERN = r"""(?i)\s+on[a-z]+=["'][^"']*["']"""
DEFAULT_TITLE = "Artigo Importado"
NO_PAGE_ERROR = "Não foi possível obter o conteúdo da URL"

# --- import ----------------------------------------------------------------

EXTRACTED_MIN_BYTES = 500
FEED_TEXT_MIN_BYTES = 200
QUANTITY_MIN, QUANTITY_MAX = 1, 20
TIME_PATTERN = r"^([01]\d|2[0-3]):[0-5]\d$"
DEFAULT_TIME = "09:00"
UNTRUSTED_REASON = "Fonte não confiável"
NO_CONTENT_ERROR = "Conteúdo não encontrado"
UNKNOWN_UPDATE = "Desconhecido"
UNTITLED_FEED = "Feed sem título"
SEO_DESCRIPTION_KEYS = ("_yoast_wpseo_metadesc", "rank_math_description", "_seopress_titles_desc")
CREDIT_LABEL = "Artigo Original:"
CREDIT_STYLES = {
    "box": "border-left: 4px solid #007cba; padding: 15px; background-color: #f5f5f5; margin-bottom: 20px;",
    "head": "margin: 0; font-weight: bold;",
    "body": "margin: 5px 0 0 0;",
}

# --- logs ------------------------------------------------------------------

LOG_LEVELS = ("INFO", "WARNING", "ERROR", "SUCCESS")
LOG_KEEP = 1000
LOG_PAGE = 50

# --- language and translation ---------------------------------------------

ENGLISH_WORDS = (
    "the", "and", "to", "of", "a", "in", "that", "is", "it", "for",
    "you", "with", "on", "this", "be", "are", "as", "at", "from",
    "have", "or", "by", "one", "had", "not", "but", "what", "all",
    "were", "when", "we", "there", "can", "an", "your", "which",
    "their", "will", "would", "if", "about", "get", "just", "know",
)
PORTUGUESE_WORDS = (
    "o", "a", "os", "as", "um", "uma", "uns", "umas", "de", "do",
    "da", "dos", "das", "em", "no", "na", "nos", "nas", "por", "para",
    "com", "sem", "que", "se", "não", "como", "mais", "mas", "foi",
    "está", "ser", "tem", "era", "são", "esta", "este", "isso",
    "ele", "ela", "eles", "elas", "meu", "minha", "teu", "tua",
)
LANGUAGE_MIN_HITS = 3
LANGUAGE_MIN_WORD_BYTES = 3
CACHE_TTL_DAYS = 30

LARGE_TEXT_BYTES = 30000
LARGE_HTML_BYTES = 20000
LARGE_SECTION_BYTES = 15000
LARGE_PIECE_BYTES = 5000
CHUNK_BYTES = 10000

URL_PATTERN = r"""(?i)(https?://[^\s<>"']+)"""
EMAIL_PATTERN = r"(?i)([a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,})"
CODE_PATTERN = r"(?is)<code[^>]*>.*?</code>"
PRE_PATTERN = r"(?is)<pre[^>]*>.*?</pre>"
PROTECTED = (("URL", URL_PATTERN), ("EMAIL", EMAIL_PATTERN), ("CODE", CODE_PATTERN), ("PRE", PRE_PATTERN))
PROTECTED_TOKEN = r"###(?:URL|EMAIL|CODE|PRE)_[0-9a-f]{32}###"
ANY_TAG = r"<[^>]+>"
TAG_TOKEN = r"###TAG_\d+###"
MEDIA_TOKEN = r"\[\[MEDIA_ITEM_\d+\]\]"
SECTION_START = r"(?i)(?=<(?:h[1-6]|p|div|section|article)[^>]*>)"
PARAGRAPH_START = r"(?i)(?=<p[^>]*>)"
PARAGRAPH_END = r"\n\s*\n"
SENTENCE_END = r"(?<=[.!?])\s+"

# --- rewriting -------------------------------------------------------------

MEDIA_PATTERNS = (
    r"(?i)<img[^>]+>",
    r"(?i)<iframe[^>]+></iframe>",
    r"(?is)<video[^>]*>.*?</video>",
    r"""(?is)<blockquote[^>]+class="(?:instagram-media|twitter-tweet|tiktok-embed)"[^>]*>.*?</blockquote>""",
)
REWRITE_MIN_WORDS = 30
REWRITE_DISABLED_ERROR = "Agente de IA não configurado ou desativado."
REWRITE_SHORT_ERROR = "Conteúdo muito curto para reescrita."
REWRITE_EMPTY_ERROR = "Resposta vazia da API."
REWRITE_FORMAT_ERROR = "A IA retornou um formato inválido. Tente novamente."
RESPONSE_OBJECT_PATTERN = r'(?s)\{[^{}]*"title"[^{}]*"content"[^{}]*\}'

DEFAULT_TONE = "jornalistico"
TONES = {
    "jornalistico": "jornalístico: imparcial, informativo e direto",
    "descontraido": "descontraído: acessível, próximo do leitor, sem perder a precisão dos fatos",
    "institucional": "institucional: formal, respeitoso, adequado para órgãos públicos e empresas",
}
DEFAULT_LANGUAGE_NAME = "português brasileiro"
LANGUAGE_NAMES = {
    "pt-BR": "português brasileiro",
    "pt-PT": "português europeu",
    "es": "espanhol",
    "en": "inglês",
    "fr": "francês",
}
LANGUAGE_RULE = (
    "O texto original pode estar em outro idioma. "
    "Reescreva SEMPRE em {language}, sem mencionar que houve tradução.\n"
)
MEDIA_RULE = (
    "\n\nINSTRUÇÕES OBRIGATÓRIAS SOBRE MULTIMÍDIA:\n"
    "- O texto contém marcadores como [[MEDIA_ITEM_0]], [[MEDIA_ITEM_1]], etc.\n"
    "- Estes marcadores representam imagens e vídeos originais.\n"
    "- Você DEVE manter todos os marcadores no texto reescrito, posicionando-os nos parágrafos "
    "onde o contexto faz mais sentido.\n"
    "- NÃO remova, não altere e não traduza os marcadores [[MEDIA_ITEM_X]].\n"
)
# Slots written as {name}; the literal braces of the JSON sample are kept as they are.
PROMPT_TEMPLATE = """Você é um editor sênior de um portal de notícias de alta qualidade. Sua tarefa é reescrever a notícia abaixo para torná-la única e profissional, mantendo TODA a profundidade original.

OBJETIVOS:
- Melhorar a fluidez e coesão entre os parágrafos.
- Eliminar repetições, mas preservar TODOS os fatos, nomes, datas e citações.
- Tom: {tone}
- IMPORTANTE: NÃO RESUMA. Mantenha a mesma quantidade de informação e detalhamento do original.

{language_rule}
{media_rule}

REGRAS:
1. O texto final deve ter entre {min_words} e {max_words} palavras. 
2. NÃO invente informações.
3. Use tags <p> e </p> para estruturar os parágrafos.
4. Mantenha a formatação <strong> para ênfase quando necessário.
5. Responda APENAS com o JSON no formato solicitado.

FORMATO DE RESPOSTA:
{
  "title": "Título reescrito aqui",
  "meta_description": "Resumo de até 155 caracteres para SEO",
  "content": "<p>Conteúdo reescrito aqui, incluindo os marcadores [[MEDIA_ITEM_X]] se houver...</p>"
}

--- TÍTULO ORIGINAL ---
{title}

--- CONTEÚDO ORIGINAL ---
{content}

--- INFORMAÇÕES ADICIONAIS ---
- Palavras no original: {word_count}
- Elementos multimídia para preservar: {media_count}"""


# --- log messages of a run -------------------------------------------------

RUN_STARTED_MESSAGE = "Iniciando importação diária automática"
FEED_SCHEDULED_MESSAGE = "Processando feed agendado: {feed} (qtd: {quantity}, traduzir: {translate}, categoria: {category})"
YES, NO = "sim", "não"
FEED_ERROR_MESSAGE = "Erro ao buscar feed: {error}"
REWRITE_FAILED_MESSAGE = "Agente IA falhou, usando tradutor simples: {error}"
RUN_DONE_MESSAGE = "Importação diária concluída: {imported} importados, {skipped} pulados, {failed} falhas"
ITEM_FAILED_MESSAGE = "Falha ao importar: {title} — {error}"
