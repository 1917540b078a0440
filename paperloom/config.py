"""Settings and fixed values of the document analytics: sizes, limits, categories, word lists and prompts."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Sizes and limits, all of which are arguments where they are used.
    extensions: tuple[str, ...] = (".pdf", ".docx", ".txt", ".md")
    chunk_size: int = 1000
    chunk_overlap: int = 200
    least_text: int = 20
    retrieved: int = 5
    sample_chars: int = 6000
    most_entities: int = 25
    bill_chars: int = 3000
    most_candidates: int = 20
    forecast_days: int = 30
    scanned_chunks: int = 200


SETTINGS = Settings()

# Fixed values.
CATEGORIES = ["Utilities", "Rent/Mortgage", "Insurance", "Subscriptions", "Telecom", "Credit Card", "Loan", "Medical", "Other"]
ENTITY_TYPES = ["person", "organization", "location", "date", "amount", "product", "other"]
STOPWORDS = [
    "The", "This", "That", "These", "Those", "A", "An", "It", "Its", "In", "On", "At", "For", "With", "As", "Of",
    "To", "From", "By", "And", "Or", "But", "If", "When", "While", "January", "February", "March", "April",
    "May", "June", "July", "August", "September", "October", "November", "December",
]
ANSWER_PROMPT = """You are an AI assistant specialized in analyzing the provided documents. Use the following pieces of context extracted from the documents to answer the question accurately and concisely. If you don't know the answer based *only* on the context provided, explicitly state that the information is not available in the documents. Do not make up information or use external knowledge.

Context:
{context}

Question: {question}

Answer:"""
SUMMARY_PROMPT = """You are an AI assistant specialized in analyzing documents. Below are representative excerpts drawn from a folder of documents ({document_names}). Write a 1-page executive summary of the whole folder: what these documents are, their main topics, and their most important points. Base the summary *only* on the excerpts provided. Write in clear prose, no headings, no bullet points.

DOCUMENTS: {document_names}

EXCERPTS:
{excerpts}

EXECUTIVE SUMMARY:"""
ENTITIES_PROMPT = """Read the excerpts below and list the key named entities they mention: people, organizations, locations, dates, monetary amounts, and products. Respond with *only* a JSON array, no other text, in this exact format:
[{"text": "Acme Corp", "type": "organization"}, {"text": "March 3, 2025", "type": "date"}]
Allowed "type" values: person, organization, location, date, amount, product, other. Include at most 25 entities, most important first.

EXCERPTS:
{excerpts}

JSON:"""
BILL_PROMPT = """You are analyzing ONE document to decide whether it is a bill, invoice, or financial statement that requires payment.

Below is the document text, followed by amount candidates and date candidates already found in it by exact text matching. You must choose your answers for total_due, due_date, and issue_date *only* from these exact candidate strings — never invent, calculate, or reformat a value. If the correct value is not among the candidates, leave that field as an empty string.

DOCUMENT:
{document_text}

AMOUNT CANDIDATES:
{amount_candidates}

DATE CANDIDATES:
{date_candidates}

Decide: is this a bill/invoice/statement requiring payment? Who is the vendor? What spending category does it belong to? Which candidate is the total amount due? Which candidate is the due date? Which candidate is the issue or statement date?"""
NO_TEXT = "No document text was available to summarize."
NO_SUMMARY = "The model did not return a summary. Try Refresh, or pick a different model."
