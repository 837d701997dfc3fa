"""The canonical schema: fields, the kind of value each holds, and the headers that mean it."""

from __future__ import annotations

from dataclasses import dataclass, field

# Results depend on these lists and on their order (ties go to what is declared first).
CANONICAL = {
    "id": ("text", ["id", "ID", "record id", "ref", "reference", "reference number", "customer id", "client id", "order id", "invoice id", "sku", "index", "row id", "no.", "no", "#"]),
    "full_name": ("text", ["name", "full name", "customer name", "client name", "contact name", "person", "employee name", "student name", "first and last name", "client", "customer", "contact"]),
    "email": ("email", ["email", "e-mail", "email address", "e-mail address", "contact email", "mail"]),
    "phone": ("phone", ["phone", "phone number", "contact number", "mobile", "mobile number", "telephone", "cell", "cell phone", "tel"]),
    "amount": ("currency", ["amount", "total", "price", "cost", "value", "amount due", "total amount", "invoice amount", "sale price", "revenue", "unit price", "subtotal", "grand total"]),
    "date": ("date", ["date", "created date", "order date", "invoice date", "timestamp", "date of birth", "dob", "due date", "start date", "end date", "transaction date", "date created", "date modified"]),
    "address": ("text", ["address", "street address", "mailing address", "location", "billing address", "shipping address"]),
    "company": ("text", ["company", "company name", "organization", "employer", "business name"]),
    "status": ("text", ["status", "state", "order status", "payment status", "stage"]),
    "quantity": ("number", ["quantity", "qty", "count", "units", "number of items"]),
    "notes": ("text", ["notes", "comments", "remarks", "description", "details"]),
}
# What stands for no data, after stripping and in lower case.
NULL_PLACEHOLDERS = ["", "n/a", "na", "none", "null", "-", "--", "tbd", "unknown", "?", "pending", "n.a.", "nil"]
# Date formats in the order in which they are tried.
US_DATES = ["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%m-%d-%Y", "%d-%m-%Y", "%Y/%m/%d", "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y", "%m/%d/%y", "%d/%m/%y"]
INTERNATIONAL_DATES = ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%m-%d-%Y", "%Y/%m/%d", "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y", "%d/%m/%y", "%m/%d/%y"]

VALUE_TYPES = ("text", "date", "number", "currency", "email", "phone")


@dataclass
class FieldRegistry:
    """Canonical fields in order; extend with ``add`` rather than by editing the defaults."""

    fields: dict[str, tuple[str, list[str]]] = field(default_factory=lambda: {k: (t, list(s)) for k, (t, s) in CANONICAL.items()})

    def add(self, name: str, value_type: str, synonyms: list[str]) -> None:
        if value_type not in VALUE_TYPES:
            raise ValueError(f"value type must be one of {', '.join(VALUE_TYPES)}")
        known = self.fields.get(name, (value_type, []))[1]
        self.fields[name] = (value_type, known + [s for s in synonyms if s not in known])

    def type_of(self, name: str) -> str:
        return self.fields[name][0]

    def numeric(self) -> list[str]:
        return [k for k, (t, _) in self.fields.items() if t in ("number", "currency")]

    def synonyms(self) -> list[tuple[int, str, str]]:
        """(order, field, synonym) in declaration order."""
        return [(i, f, s) for i, (f, s) in enumerate((f, s) for f, (_, many) in self.fields.items() for s in many)]
