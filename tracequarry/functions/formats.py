"""Formats, limits and word lists that results depend on byte for byte."""

from __future__ import annotations

# --- Fixed values: hash domains and identifiers in stored formats ---
SNAPSHOT_DOMAIN = b"hsum.snapshot.v1\0"
LAYOUT_DESCRIPTOR = "hsum.chunk-layout.v1\0kind={kind}\ntarget=1200\nmax=1800\noverlap-max=180\n"
SOURCE_ID_DOMAIN = b"hsum.alpha1.filesystem-source\0"
CURSOR_DOMAIN = b"hsum.mcp.cursor.v1"
CITATION_PREFIX = "hsum://v1/"
PIPELINE_DESCRIPTOR = (
    "hsum.pipeline.v1\n"
    "filesystem=v1:extensions={extensions}:symlinks=never\n"
    "connector_key=platform-raw-relative-bytes:no-unicode-or-case-normalization\n"
    "source_uri=repo-v1:rfc3986-unreserved:slash-preserved:uppercase-percent\n"
    "snapshot_hash=sha256-length-framed-rfc8785-utc\n"
    "content=original-utf8:line-endings-preserved:nul-rejected\n"
    "chunker=bytes-v1:target-1200:max-1800:overlap-max-180:bom-search-start-3\n"
    "chunk_layout_key=sha256-domain-separated:chunk-kind+settings\n"
    "fts=unicode61:remove_diacritics-0:tokenchars-_-.:/\n"
    "literals=case-sensitive:max-64:bytes-2..128\n"
    "quote_bloom=byte-trigram:bits-4096:hashes-4:sha256-double-hash-be\n"
    "embedding=none\n"
)
RETRIEVAL_DESCRIPTOR = (
    "hsum.retrieval-config.v1\n"
    "modes=auto,lexical:auto-effective-lexical\n"
    "retrievers=identifier-literal,quoted-byte-bloom-aho,fts5-bm25\n"
    "candidates=initial-50:step-50:max-per-list-500:max-results-50\n"
    "fusion=integer-rrf:k-60:scale-1000000000000:exact-weight-3/2:lexical-weight-1\n"
    "rounding=half-up\n"
    "dedupe=same-content-sha256-or-same-document-overlap-at-least-half\n"
    "order=fusion-desc,matched-exact-bytes-desc,source-id,document-id,start-byte\n"
)

# --- Fixed values: file extensions and the chunk kind of each, in order ---
EXTENSIONS = {
    "md": "markdown", "markdown": "markdown", "txt": "plain-text", "rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript",
    "js": "javascript", "jsx": "javascript", "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin", "c": "c", "h": "c", "cpp": "cpp",
    "hpp": "cpp", "cc": "cpp", "hh": "cpp", "cxx": "cpp", "rb": "ruby", "cs": "csharp", "swift": "swift", "php": "php", "scala": "scala",
    "sh": "shell", "bash": "shell", "sql": "sql",
}

# --- Fixed values: beginnings of declarations by chunk kind ---
DECLARATIONS = {
    "rust": ("fn ", "pub fn ", "pub(crate) fn ", "struct ", "pub struct ", "enum ", "pub enum ", "trait ", "pub trait ", "impl ", "mod ", "pub mod "),
    "python": ("def ", "async def ", "class "),
    "typescript": ("function ", "export function ", "export async function ", "class ", "export class ", "interface ", "export interface ", "type ", "export type "),
    "javascript": ("function ", "async function ", "export function ", "export async function ", "class ", "export class "),
    "go": ("func ", "type "),
    "java": ("class ", "public class ", "abstract class ", "final class ", "interface ", "public interface ", "enum ", "public enum ", "record ", "public record ", "public ", "private ", "protected ", "static "),
    "kotlin": ("fun ", "suspend fun ", "class ", "data class ", "sealed class ", "object ", "interface ", "enum class ", "val ", "var "),
    "c": ("struct ", "union ", "enum ", "typedef ", "static ", "extern ", "void ", "int ", "char ", "unsigned ", "const ", "#define "),
    "cpp": ("class ", "struct ", "namespace ", "template ", "enum ", "union ", "typedef ", "using ", "void ", "static ", "inline ", "explicit ", "virtual ", "#define "),
    "ruby": ("def ", "class ", "module ", "attr_reader ", "attr_writer ", "attr_accessor "),
    "csharp": ("class ", "public class ", "interface ", "struct ", "enum ", "record ", "namespace ", "public ", "private ", "protected ", "internal ", "static "),
    "swift": ("func ", "class ", "struct ", "enum ", "protocol ", "extension ", "actor ", "public ", "private ", "internal ", "var ", "let "),
    "php": ("function ", "class ", "interface ", "trait ", "namespace ", "public function ", "private function ", "protected function ", "abstract ", "final "),
    "scala": ("def ", "class ", "case class ", "object ", "trait ", "sealed ", "val ", "var "),
}

# --- Fixed values: names that discovery leaves out ---
EXCLUDED_DIRECTORIES = ("target", "node_modules", "build", "dist", "out", "vendor", "__pycache__", "venv")
SENSITIVE_DIRECTORIES = (".git", ".ssh", ".aws", ".gnupg", ".config", ".cache", ".idea", ".vscode")
SENSITIVE_NAMES = (".env", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "credentials", "credentials.json")
SENSITIVE_EXTENSIONS = ("pem", "key", "p12", "pfx")

# --- Fixed values: limits ---
TARGET_BYTES, MAX_BYTES, OVERLAP_BYTES = 1200, 1800, 180
LITERAL_MIN, LITERAL_MAX, LITERALS = 2, 128, 64
QUERY_BYTES, ATOM_BYTES, ATOMS = 4096, 256, 16
RESULTS_DEFAULT, RESULTS_MAX = 10, 50
CANDIDATES_INITIAL, CANDIDATES_MAX = 50, 500
DEADLINE_DEFAULT_MS, DEADLINE_MIN_MS, DEADLINE_MAX_MS = 3000, 100, 10_000
DRIFT_DEADLINE_MS = 500
GET_DEFAULT, GET_MAX = 16 * 1024, 64 * 1024
PAGE_BODY_BYTES = 256 * 1024
FILES_DEFAULT, FILES_MAX = 10_000, 50_000
SOURCE_BYTES_DEFAULT, SOURCE_BYTES_MAX = 2 << 30, 8 << 30
FILE_BYTES_DEFAULT, FILE_BYTES_MAX = 2 << 20, 16 << 20
ENTRIES_MAX, DIRECTORIES_MAX, DEPTH_MAX, ENTRIES_PER_DIRECTORY = 100_000, 10_000, 128, 50_000
RRF_K, RRF_SCALE = 60, 10**12
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6
BLOOM_BITS, BLOOM_HASHES = 4096, 4


def chunk_kind(path: str) -> str | None:
    """Chunk kind by the exact extension of a path's last segment; dot-names without another dot have none."""
    name = path.rsplit("/", 1)[-1]
    stem, dot, extension = name.rpartition(".")
    return EXTENSIONS.get(extension) if dot and stem else None


def pipeline_descriptor() -> str:
    return PIPELINE_DESCRIPTOR.format(extensions=",".join(EXTENSIONS))
