"""Lists, patterns, prompts and defaults whose exact content decides results."""

# Segmentation defaults.
BATCH_SIZE = 5
GROUP_SIZE = 3
SIMILARITY_THRESHOLD = 0.7
NEW_CONFIDENCE = 70
SHIFT_CONFIDENCE = 85
MAX_TERMS = 1000

# Frame sampling, thumbnail and detection defaults.
INTERNAL_FRAMES = 3
MIN_INTERNAL_DURATION = 2.0
THUMBNAIL_INTERVAL = 30
MAX_THUMBNAILS = 10
LOGO_THRESHOLD = 0.8
MIN_THUMBNAIL_CONFIDENCE = 0.7

# Audio defaults.
SILENCE_DB = -25.0
SILENCE_SECONDS = 1.5
AUDIBLE_SPEED = 2.0
SILENT_SPEED = 8.0
SAMPLE_RATE = 16000
GAIN_DB = -3.0

# Topic model settings.
LDA_TOPICS = 5
LDA_SEED = 100
LDA_PASSES = 10

# Annotation used when a response cannot be read.
UNREADABLE_TOPIC = "Unknown"
UNREADABLE_RELATIONSHIP = "NEW"
UNREADABLE_CONFIDENCE = 0.0

# Ordered project stages.
STAGES = {
    "PROJECT_CREATED": 0,
    "YOUTUBE_DOWNLOAD_COMPLETE": 1,
    "AUDIO_PROCESSED": 2,
    "TRANSCRIPTION_COMPLETE": 3,
    "TRANSCRIBE_ONLY_COMPLETE": 4,
    "TOPIC_MODELING_COMPLETE": 5,
    "SEGMENTS_IDENTIFIED": 6,
    "VIDEO_ANALYZED": 7,
    "SCREENSHOT_ANALYZED": 8,
    "PROCESS_COMPLETE": 9,
}

# Video URL pattern and thumbnail qualities, best first.
VIDEO_URL = r"^(https?://)?(www\.)?(youtube\.com/watch\?v=|youtu\.be/)[a-zA-Z0-9_-]{11}$"
THUMBNAIL_QUALITIES = ["maxresdefault", "sddefault", "hqdefault", "mqdefault", "default"]
THUMBNAIL_URL = ("https://img.youtube.com/vi/", ".jpg")

# Accepted file endings and error texts.
IMAGE_ENDINGS = [".png", ".jpg", ".jpeg"]
MEDIA_ENDINGS = [".mp4", ".mkv", ".json"]
NOT_FOUND = "Input file not found: "
BAD_IMAGE = "Unsupported image format. Supported formats: .png, .jpg, .jpeg"
BAD_MEDIA = "Unsupported file format. Supported formats: .mp4, .mkv, .json"

# The customary public English stop-word list, in its usual order.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had having
do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't
couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn
mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't
wouldn wouldn't
""".split()

# Prompt texts by register. {context} and {transcript} mark what is filled in.
DEFAULT_REGISTER = "it-workflow"
TOPIC_PROMPTS = {
    "it-workflow": """
        Analyze this segment with a focus on IT workflow patterns:

        {context}

        Consider:
        1. Technical procedures and system commands
        2. Software configuration steps
        3. System interaction patterns
        4. Technical terminology and jargon
        5. Step-by-step process structures

        Identify:
        - Main workflow topic
        - Technical tools and commands used
        - Configuration patterns
        - System interaction sequences

        Format response as JSON:
        {
            "topic": "main workflow topic",
            "keywords": ["technical term 1", "command 2", ...],
            "relationship": "CONTINUATION|SHIFT|NEW",
            "confidence": 85
        }
        """,
    "gen-ai": """
        Analyze this segment with a focus on generative AI patterns:

        {context}

        Consider:
        1. AI model architectures and parameters
        2. Prompt engineering techniques
        3. Model output patterns
        4. Implementation strategies
        5. API integration methods

        Identify:
        - Main AI topic
        - Model-specific terminology
        - Technical parameters
        - Implementation patterns

        Format response as JSON:
        {
            "topic": "main AI topic",
            "keywords": ["model term 1", "parameter 2", ...],
            "relationship": "CONTINUATION|SHIFT|NEW",
            "confidence": 85
        }
        """,
    "tech-support": """
        Analyze this segment with a focus on technical support patterns:

        {context}

        Consider:
        1. Problem descriptions and symptoms
        2. Diagnostic procedures
        3. Error patterns and messages
        4. Resolution steps
        5. Verification methods

        Identify:
        - Main support topic
        - Technical issues
        - Resolution patterns
        - Verification steps

        Format response as JSON:
        {
            "topic": "main support topic",
            "keywords": ["error term 1", "solution 2", ...],
            "relationship": "CONTINUATION|SHIFT|NEW",
            "confidence": 85
        }
        """,
}
ANALYSIS_PROMPTS = {
    "it-workflow": """
        Analyze this video segment focusing on IT workflow patterns.

        Transcript: '{transcript}'

        Please identify:
        1. Software tools and applications in use
        2. Command-line operations and syntax
        3. System configuration steps
        4. Technical procedures and workflows
        5. Integration patterns between tools

        Pay special attention to:
        - Technical terminology and commands
        - Tool-specific operations
        - System interaction patterns
        - Configuration sequences
        - Workflow transitions

        Format the findings with clear technical details and command syntax.
        """,
    "gen-ai": """
        Analyze this video segment focusing on generative AI patterns.

        Transcript: '{transcript}'

        Please identify:
        1. AI models and architectures discussed
        2. Prompt engineering techniques
        3. Model parameters and configurations
        4. Implementation strategies
        5. API integration patterns

        Pay special attention to:
        - Model-specific terminology
        - Parameter adjustments
        - Output patterns
        - Integration methods
        - Performance considerations

        Format the findings with clear technical details and implementation patterns.
        """,
    "tech-support": """
        Analyze this video segment focusing on technical support patterns.

        Transcript: '{transcript}'

        Please identify:
        1. Problem descriptions and symptoms
        2. Error messages and patterns
        3. Diagnostic procedures
        4. Resolution steps
        5. Verification methods

        Pay special attention to:
        - Error patterns and messages
        - Diagnostic sequences
        - Resolution procedures
        - Verification steps
        - System state changes

        Format the findings with clear technical details and resolution patterns.
        """,
}

# Context and prompt wording.
PREVIOUS_CONTEXT = ("Previous segment context:\nContent: ", "\nTopic: ", "\n\n")
CURRENT_CONTEXT = "Analyze the following segment:\n"
SCREENSHOT_OPENING = "Analyze this screenshot and describe what you see."
SCREENSHOT_CATALOG = "\n\nDetected software applications:\nSoftware list: "
SCREENSHOT_CLOSING = (
    "\n\nFocus on identifying software applications, user interfaces, and any notable visual elements. "
    "Be specific about what is visible in the image."
)
