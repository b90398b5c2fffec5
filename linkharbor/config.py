"""Run configuration: what is looked for, what is stored, and which readings of unclear rules apply."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: Options of the command line and whether they take a value.
OPTIONS = {
    "-retrieveDataType": True, "-inputFileFullPath": True, "-downloadDocFiles": False, "-docFilesStorage": True, "-downloadJustHtmlFiles": False,
    "-htmlFilesStorage": True, "-fileNameType": True, "-firstFileNum": True, "-inputDataUrl": True,
}
MAX_TOKENS = 12


@dataclass(frozen=True)
class Config:
    """All knobs.  ``strict_reference`` keeps literal defects of the described behaviour (see the Q notes in the
    functions); the default is the evidently intended meaning."""

    documents: bool = True
    datasets: bool = True
    download_docs: bool = False
    download_html: bool = False
    storage: str | None = None
    file_name_type: str | None = None
    first_file_number: int = 1
    input_path: str | None = None
    input_url: str | None = None
    id_mode: bool = True
    skip_header: bool = False
    batch_size: int = 3000
    all_dataset_links: bool = True
    remaining_links: bool = True
    block_most_5xx: bool = True
    max_document_bytes: int = 512 * 1024 * 1024
    max_html_bytes: int = 5 * 1024 * 1024
    politeness_ms: tuple[int, int] = (3000, 7000)
    strict_reference: bool = False

    @property
    def target_key(self) -> str:
        """Name of the fourth output key."""
        return {(True, False): "docUrl", (False, True): "datasetUrl"}.get((self.documents, self.datasets), "docOrDatasetUrl")

    @property
    def downloads(self) -> bool:
        return self.download_docs or self.download_html

    def resolved(self) -> Config:
        """Defaults that depend on other options; originals' names are not kept in an object store."""
        kind = self.file_name_type or ("numberName" if self.download_html else "idName")
        if not self.id_mode and kind == "idName":
            kind = "numberName"
        if kind == "originalName" and self.storage == "S3ObjectStore":
            kind = "idName" if self.id_mode else "numberName"
        return replace(self, file_name_type=kind)


def parse_args(args: list[str]) -> tuple[Config, list[str]]:
    """Options to a Config, and the tokens that were not understood (which are ignored).

    Raises ValueError for more than 12 tokens, a missing value, an unknown value, or both download modes.
    """
    if len(args) > MAX_TOKENS:
        raise ValueError(f"at most {MAX_TOKENS} tokens, got {len(args)}")
    given: dict[str, str | None] = {}
    ignored, i = [], 0
    while i < len(args):
        name = args[i]
        if name not in OPTIONS:
            ignored.append(name)
        elif OPTIONS[name]:
            i += 1
            if i == len(args):
                raise ValueError(f"{name} needs a value")
            given[name] = args[i]
        else:
            given[name] = None
        i += 1
    kinds = {"document": (True, False), "dataset": (False, True), "all": (True, True)}
    kind = given.get("-retrieveDataType", "all")
    if kind not in kinds:
        raise ValueError(f"unknown data type {kind}")
    names = given.get("-fileNameType")
    if names not in (None, "originalName", "idName", "numberName"):
        raise ValueError(f"unknown file name type {names}")
    number = int(given.get("-firstFileNum") or 1)
    c = Config(
        documents=kinds[kind][0], datasets=kinds[kind][1], download_docs="-downloadDocFiles" in given, download_html="-downloadJustHtmlFiles" in given,
        storage=given.get("-docFilesStorage") or given.get("-htmlFilesStorage"), file_name_type=names, first_file_number=number if number > 0 else 1,
        input_path=given.get("-inputFileFullPath"), input_url=given.get("-inputDataUrl"),
    )
    if c.download_docs and c.download_html:
        raise ValueError("the two download modes exclude each other")
    return c.resolved(), ignored
