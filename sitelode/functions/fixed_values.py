"""Fixed values of the questionnaire: texts and cut points that results must equal."""

QUIZ_VERSION = "v2.1"
N_QUESTIONS = 11
MAX_ANSWER = 3

# Tier names in order, each with its highest total.
TIERS = (("Observer", 7), ("Explorer", 16), ("Operator", 25), ("Integrator", 33))

# Tier definitions, result copy, call to action and landing path.
TIER_COPY = (
    (
        "Observer",
        "AI is not yet part of regular work.",
        "AI isn’t part of your regular work yet, and that’s a clear starting point, not a deficit. Most professionals are earlier in this shift than the headlines suggest.",
        "Pick one small, low-stakes task this week, like summarizing a document or drafting a first version of an email, and run it through an AI tool. One concrete use teaches more than ten articles.",
        "Explore AI foundations",
        "/ai-training-workforce-development/",
    ),
    (
        "Explorer",
        "Experimenting with occasional or narrow uses.",
        "You’ve started using AI in real work, occasionally or in a narrow lane. The gap between you and heavier users isn’t talent; it’s repeatability.",
        "Choose one recurring task and run it with AI five times, refining your approach each round. Repetition is what turns experiments into capability.",
        "Find a practical use case",
        "/ai-training-workforce-development/",
    ),
    (
        "Operator",
        "Using AI regularly, effectively, and repeatably.",
        "AI is genuinely working for you: regular use, multiple use cases, and habits that get results. You’re getting real leverage from these tools.",
        "Take your single best prompt or approach and turn it into a saved, reusable asset: a template, a configured assistant, a documented workflow. That’s the step from using AI to operating a system.",
        "Turn a task into a workflow",
        "/operations/",
    ),
    (
        "Integrator",
        "Systematically embedding AI into workflows, tools, and ways of working.",
        "You’re systematically embedding AI into how work gets done: repeatable workflows, configured tools, and ways of working built around it. You’re creating leverage, not just using it.",
        "Inventory what you’ve built and who or what depends on it. Systematized AI use is an asset, and it deserves the same care as any system: documentation, review, and a plan to scale it responsibly.",
        "Scale AI responsibly",
        "/agentic-ai/",
    ),
)

# Dimension, display label and the four options of each scored question, in order.
QUESTIONS = (
    (
        "Frequency",
        "How often you use AI",
        ("Rarely or never", "A few times a month", "A few times a week", "Most working days"),
    ),
    (
        "Breadth",
        "Range of uses",
        (
            "Nothing regular yet",
            "Mostly one kind of task (like drafting or summarizing)",
            "A few regular kinds of tasks",
            "It touches most parts of my work: writing, analysis, research, planning, and more",
        ),
    ),
    (
        "Integration",
        "Built into your work",
        (
            "It isn’t part of my work",
            "I use it now and then, when I remember",
            "I use it most days, but ad hoc with no set patterns",
            "Parts of my work are built around repeatable AI steps; changing tools would mean redesigning how those tasks get done",
        ),
    ),
    (
        "Iteration",
        "Working through problems",
        (
            "I take what it gives, or this hasn’t come up",
            "I rephrase once; if it’s still off, I do the task myself",
            "I ask follow-up questions until it improves",
            "I work out what failed, add the missing context or structure, and check the revised result, or stop using AI for that task if it can’t be made reliable",
        ),
    ),
    (
        "Context",
        "What you give the AI",
        (
            "I haven’t used it enough to have a habit",
            "A quick question, a line or two",
            "A carefully written request with good detail",
            "Appropriate source material I’m permitted to use, such as documents, data, or examples, plus detailed instructions and the output format I need",
        ),
    ),
    (
        "Tooling",
        "Tools & features",
        (
            "Basic chat, or I haven’t used them",
            "Built-in features like file uploads, projects, voice, or deep research",
            "Reusable setups I configured myself: custom GPTs or assistants, workspaces with standing instructions",
            "Connected workflows: AI linked to other tools through automations, APIs, or agents",
        ),
    ),
    (
        "Building for others",
        "Building for others",
        (
            "Doesn’t apply; I don’t really use AI",
            "My use is just for me",
            "I’ve shared prompts or shown colleagues how to do things",
            "I’ve built a repeatable AI tool, workflow, or template that others use for a defined purpose",
        ),
    ),
    (
        "Tool selection",
        "Choosing the right tool",
        (
            "I don’t make that choice",
            "I use whatever’s in front of me",
            "I have a go-to tool, and switch if it struggles",
            "I deliberately match the tool or model to the kind of task",
        ),
    ),
    (
        "Output handling",
        "Checking the output",
        (
            "It usually goes out with little or no checking",
            "I don’t generally use AI for work that matters",
            "A careful read-through and edit",
            "I verify the facts and figures against sources, then edit. The AI draft is a starting point",
        ),
    ),
    (
        "Systematization",
        "Reusing what works",
        (
            "I use it once and move on",
            "I try to remember how I did it next time",
            "I save the prompt, instructions, or setup so I can reuse it",
            "I turn it into a repeatable workflow, template, or tool and improve it over time",
        ),
    ),
    (
        "Capability expansion",
        "Taking on new things",
        (
            "No, or too early to tell",
            "It saves time on things I could already do",
            "Once or twice it’s let me do something genuinely new",
            "Regularly. There’s work I now do that I couldn’t have done before",
        ),
    ),
)

# Goal letter and the phrase reflected back; the last goal has none.
GOALS = (
    ("A", "getting better results on individual tasks"),
    ("B", "creating repeatable workflows for your own work"),
    ("C", "building tools or automations other people can use"),
    ("D", "redesigning how a team or business operates"),
    ("E", None),
)

# The sentence around tier and goal.
GOAL_SENTENCE = (
    "You’re currently an <b>",
    "</b>, and your next goal is <b>",
    "</b>. That’s exactly the right kind of gap to work on.",
)
