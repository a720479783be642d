"""Fixed texts: prompts, word lists, patterns and messages.

Everything in this file is a fixed value that has to be exact for results to
agree; no logic lives here.
"""

# ---- fixed values: questions ------------------------------------------------
ROUTE_PATTERN = r"(?i)(GET|POST|PUT|DELETE|PATCH)[\t\n\f\r ]+([/\w-]+)[\t\n\f\r ]+(?:on|in)[\t\n\f\r ]+([\w-]+)"
ARCHITECTURE_WORDS = [
    "architecture",
    "lambda",
    "sns",
    "s3",
    "vpc",
    "subnet",
    "step function",
    "eventbridge",
    "api gateway",
    "trigger",
    "cloudformation",
]
NOT_IMPLEMENTED = "Query intent not yet implemented"
NO_SNAPSHOT = "no infrastructure snapshot found for this project; run a scan first"

# ---- fixed values: messages; %s is filled in ---------------------------------
SCAN_MESSAGES = {
    "no_build_output": ("no supported IaC files found in %s", "project"),
    "manifest_unreadable": ("could not read cdk manifest.json", None),
    "manifest_unparsable": ("could not parse cdk manifest.json", None),
    "no_stack": ("no aws:cloudformation:stack artifact found in cdk manifest", None),
    "template_unreadable": ("could not read template file %s", "template_file"),
    "template_unparsable": ("could not parse template file %s", "template_file"),
}
API_MISSING = "API Gateway '%s' not found"
ROUTE_MISSING = "Path '%s' with method '%s' not found in API '%s'"

# ---- fixed values: redaction, in order --------------------------------------
# (tag, pattern, a piece of text every match holds or None). \w and \d are
# ASCII-only in Java regular expressions while \b is not, so word edges are
# written as look-arounds; the leading one follows the first digit, so that other
# characters are passed over by their class alone.
REDACTIONS = [
    ("ARN", r"arn:[A-Za-z0-9\-_:/.]+", "arn:"),
    ("ACCOUNT_ID", r"\d(?<!\w\d)\d{11}(?!\w)", None),
    ("IP", r"\d(?<!\w\d)\d{0,2}(?:\.\d{1,3}){3}(?!\w)", None),
    ("S3", r"s3://[A-Za-z0-9.\-_/]+", "s3://"),
]
PLACEHOLDER = r"\[\[(?:ARN|ACCOUNT_ID|IP|S3)_\d+\]\]"

# ---- fixed values: answer clean-up ------------------------------------------
FILLER_PHRASES = [
    "Based on the provided infrastructure context,",
    "From the context, we know that",
    "If you have any further questions or if there's anything else I can help you with, please let me know!",
    "To find out which",
    "Now, let's analyze",
    "So, in summary:",
    "However, since",
    "It's reasonable to conclude that",
]
NOISE_LINES = [("DemoApi", "Permission"), ("SourceArn",), ("Action:", "lambda:InvokeFunction")]
WEAK_SENTENCES = ["Based on", "From the context"]
LONG_ANSWER_BYTES = 500
KEPT_SENTENCES = 3

# ---- fixed values: resource kinds (type, label, name property) --------------
KEY_RESOURCES = [
    ("AWS::Lambda::Function", "Lambda", "FunctionName"),
    ("AWS::ApiGateway::RestApi", "API Gateway", "Name"),
    ("AWS::S3::Bucket", "S3 Bucket", "BucketName"),
    ("AWS::DynamoDB::Table", "DynamoDB Table", "TableName"),
]
STACK_ARTIFACT = "aws:cloudformation:stack"

# ---- fixed values: quotas ---------------------------------------------------
QUOTA_NAMES = [
    ("L-DB2E81BA", "GPU Instances (G and VT)"),
    ("L-1216C47A", "Standard Instances (A,C,D,H,I,M,R,T,Z)"),
    ("L-34B43A08", "Spot Instances"),
]
GPU_QUOTA = "L-DB2E81BA"
STANDARD_QUOTA = "L-1216C47A"
STACK_OUTPUT_KEYS = ["PublicIP", "OllamaURL", "SSHCommand"]

# ---- fixed values: training pairs -------------------------------------------
PAIR_PROMPT = "What triggers the %s Lambda?"
PAIR_COMPLETION = "It is triggered by X (placeholder – user needs richer context)."

# ---- fixed values: prompts --------------------------------------------------
ANSWER_PROMPT = """You are an expert cloud infrastructure assistant.
Your task is to answer a user's question about their infrastructure based *only* on the provided context.

IMPORTANT GUIDELINES:
1. Always use the most human-friendly, descriptive property available for each resource.
2. Look for properties that appear to be names, IDs, or descriptions (such as "Name", "ID", "Description", etc.), but do not limit yourself to these—use your best judgment based on the data provided.
3. If no such property exists, use the most descriptive identifier available.
4. Never rely on internal logical IDs unless there is no better option.
5. Be specific and actionable in your responses.
6. If you can't find the answer in the context, say "I cannot answer this based on the provided infrastructure information."
7. Keep responses concise but informative—aim for 1-3 sentences.
8. Use bullet points or numbered lists when appropriate for clarity.
9. Focus on answering the user's question directly—don't over-explain technical details unless specifically asked.
10. Avoid listing all available resources unless the question specifically asks for them.

RESPONSE STYLE:
- Be direct and to the point
- Use simple, clear language
- Focus on what the user asked, not every detail in the infrastructure
- If the answer is simple, keep it simple
- ALWAYS use friendly resource names or descriptions instead of logical IDs

--- INFRASTRUCTURE CONTEXT ---
{context}
--- END CONTEXT ---

QUESTION: {question}

Please provide a clear, concise answer using the most human-friendly resource names or descriptions:"""

INTENT_PROMPT = """You are an AWS CLI assistant. Parse the following user query into a JSON object with fields: intent, service, action, params (map), and raw_query.

Common intents:
- "api_gateway_lambda" for queries about which Lambda handles API Gateway requests
- "lambda_triggers" for queries about what triggers a Lambda function
- "cost_top" for queries about top cost services

Examples:
Query: "Which Lambda handles GET /users on prod-api?"
Response: {"intent": "api_gateway_lambda", "service": "apigateway", "action": "get_integration", "params": {"api": "prod-api", "method": "GET", "path": "/users"}, "raw_query": "Which Lambda handles GET /users on prod-api?"}

Query: "What triggers the process-order Lambda?"
Response: {"intent": "lambda_triggers", "service": "lambda", "action": "list_triggers", "params": {"lambda": "process-order"}, "raw_query": "What triggers the process-order Lambda?"}

Query: "Top 3 services by cost last 7 days"
Response: {"intent": "cost_top", "service": "costexplorer", "action": "get_cost", "params": {"limit": "3", "period": "7 days"}, "raw_query": "Top 3 services by cost last 7 days"}

Now parse this query: """
# -----------------------------------------------------------------------------
